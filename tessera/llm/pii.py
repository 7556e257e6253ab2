"""Operator 9: personal data by boosted trees over candidate spans.

Patterns with checks give the base spans, which always stay. High-recall
generators propose more, overlapping, spans: looser forms of the same kinds,
and secrets. Boosted trees score a candidate by its format and its context.
What they learn from is not what the patterns find: into stretches of a
bounded sample of documents go loose forms of the base spans found there and
of made ones (spelled-out or bracketed signs, other separators, no plus), as
positives, and look-alikes of every kind (numbers that fail a check, dates,
versions, identifiers, digests), as negatives; base spans are further
positives, candidates of the texts that cannot be what they look like further
negatives, all others teach nothing. A candidate is added if its score reaches
its kind's threshold, calibrated for precision on documents that the trees did
not see, and it overlaps no span that was taken before it.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.boosting import BINS, BoostedTrees, fit_trees
from tessera.llm.common import bounded, schema_with, table, values_of

#: Documents that the trees are fitted on, at most; loose forms, and look-alikes, that each gets; characters of a text around each; precision that a threshold must reach.
FIT_DOCUMENTS, PLANTED, AROUND, PRECISION = 3_000, 3, 80, 0.97
ROUNDS, DEPTH = 60, 4
#: The kinds of the base patterns; the method knows one more.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: Documents whose candidates are scored together.
TOGETHER = 256

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Runs of what numbers of any kind consist of; every match of the three patterns above lies within one, from a sign that begins numbers to a digit.
_RUN = re.compile(r"[0-9+ ().-]{7,}")
_BEGIN = re.compile(r"[+(0-9]")
_AT, _DOT = r"(?: ?[(\[{] ?(?:at|AT|@) ?[)\]}] ?| at | AT | ?@ ?)", r"(?: ?[(\[{] ?(?:dot|DOT|\.) ?[)\]}] ?| dot | DOT | \. |\.)"
_WIDE_AT = re.compile(_AT)
_WIDE_DOMAIN = re.compile(rf"[\w-]++(?:{_DOT}[\w-]++)+")
#: Without one of these no text holds a wide address.
_EMAIL_SIGN = re.compile(r"@|[(\[{] ?(?:at|AT) ?[)\]}]| (?:dot|DOT) ")
_WIDE_RUN = re.compile(r"[0-9+ ()\[\]{}._/dot-]{7,}")
_WIDE_IP = re.compile(r"(?<![0-9.])[0-9]{1,4}(?:(?: ?\. ?| ?[(\[{]\.[)\]}] ?| dot )[0-9]{1,4}){3}(?![0-9])")
_WIDE_CARD = re.compile(r"(?<![0-9])[0-9](?:[ ._/-]{0,3}[0-9]){12,18}(?![0-9])")
_WIDE_PHONE = re.compile(r"(?<![0-9])[+(]{0,2}[0-9](?:[ ()./_-]{0,3}[0-9]){6,14}(?![0-9])")
_WIDE_SECRET = re.compile(r"[A-Za-z0-9_+/-]{16,}={0,2}")
#: Words before a span that speak for a kind, or against any (fixed values).
CUES = {
    "email": ("mail", "e-mail", "email", "contact", "write"), "ip": ("ip", "host", "server", "addr", "address"), "card": ("card", "visa", "credit", "debit", "amex"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell"), "secret": ("token", "key", "secret", "password", "passwd", "auth", "bearer", "apikey"),
}
AGAINST = ("version", "v", "isbn", "id", "hash", "order", "section", "no", "commit", "digest", "checksum", "sha", "page", "date", "file", "ref", "item")
#: Beginnings of keys that services give out (fixed values).
PREFIXES = ("sk_live_", "sk_test_", "ghp_", "AKIA", "xoxb-", "glpat-", "AIza")

Span = tuple[int, int, int]  # index of the kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield 0, start, done
        at = text.find("@", max(at + 1, done))


def _octets(s: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in s.split("."))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, by kind, then start; a match that fails is not tried again."""
    found = list(_emails(text))
    for s, e in _runs(text, _RUN):
        found += ((1, m.start(), m.end()) for m in _IP.finditer(text, s, e) if _octets(m[0]))
        found += ((2, m.start(), m.end()) for m in _CARD.finditer(text, s, e) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d))
        found += ((3, m.start(), m.end()) for m in _PHONE.finditer(text, s, e) if 8 <= len(_digits(m[0])) <= 15)
    return sorted(found)


def _runs(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """Of each run of the pattern's characters what reaches from its first sign that begins a number to its last digit, if that is seven long."""
    for m in pattern.finditer(text):
        start, end = _BEGIN.search(text, m.start(), m.end()), m.end()
        while end > m.start() and not "0" <= text[end - 1] <= "9":
            end -= 1
        if start and end - start.start() >= 7:
            yield start.start(), end


def _wide_emails(text: str) -> Iterator[Span]:
    """From each sign to the left over what stands in an address, to the right over names between dots: every character is met a few times, however long a run of them is."""
    done, at = 0, _WIDE_AT.search(text)
    while at:
        start = at.start()
        while start > done and (text[start - 1].isalnum() or text[start - 1] in "_.%+-"):
            start -= 1
        m = _WIDE_DOMAIN.match(text, at.end()) if start < at.start() else None
        if m:
            done = m.end()
            yield 0, start, done
        at = _WIDE_AT.search(text, max(at.start() + 1, done))


def candidates(text: str, base: list[Span] | None = None) -> list[Span]:
    """Overlapping spans of all kinds, base spans included."""
    found = set(base_spans(text) if base is None else base)
    if _EMAIL_SIGN.search(text):
        found.update(_wide_emails(text))
    for s, e in _runs(text, _WIDE_RUN):
        for k, pattern in ((1, _WIDE_IP), (2, _WIDE_CARD), (3, _WIDE_PHONE)):
            found.update((k, m.start(), m.end()) for m in pattern.finditer(text, s, e))
    for m in _WIDE_SECRET.finditer(text):
        own = m[0]
        if any(c.isdigit() for c in own) and any(c.isalpha() for c in own):
            found.add((4, m.start(), m.end()))
    return sorted(found)


def _class_of(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4


def features(text: str, span: Span) -> list[int]:
    """Format and context of a candidate, as whole numbers from 0 to BINS - 1."""
    kind, s, e = span
    own = text[s:e]
    digits, groups = _digits(own), re.findall(r"[0-9]+", own)
    near = text[max(0, s - 40) : s]
    before = re.findall(r"[^\W\d_]+", near.lower())[-3:]
    domain = re.split(_AT, own)[-1] if kind == 0 else ""
    labels = re.split(_DOT, domain) if kind == 0 else []
    apart = re.findall(r"[^0-9]+", own) if kind in (1, 2, 3) else []
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(own, own[1:], strict=False)) if kind == 4 else 0
    numbers = [
        kind, len(own) // 2, len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), own.count("."), own.count("-"), own.count(" "),
        int(own[0] == "+"), int("(" in own), int("(" in own and ")" in own), int(bool(digits) and luhn(digits)), int(_octets(".".join(groups)) if len(groups) == 4 else 0),
        _class_of(text[s - 1 : s]), _class_of(text[e : e + 1]), int(any(w in CUES[ALL_KINDS[kind]] for w in before)), int(any(w in AGAINST for w in before)), len(labels),
        int(own.isascii()), int(own[-1:].isalnum()), len(labels[-1]) if labels else 0, len(set(apart)), min(map(len, apart), default=0), max(map(len, apart), default=0),
        int(bool(re.search(r"[(\[{]", own))), int(bool(re.search(r"[=:] ?[\"'`]?$", near))), int(bool(re.search(r"[\"'`]$", near))), turns, len(set(own)) if kind == 4 else 0,
        int(own.lower() != own and own.upper() != own), int(own.startswith(PREFIXES)), int(groups[0] in ("19", "20") or (len(groups[0]) == 4 and groups[0][:2] in ("19", "20")) if groups else 0),
        int(bool(re.search(r" (?:at|AT) ", own))), int(labels[-1].isalpha() if labels else 0), int(len(groups) > 1 and len(set(map(len, groups))) == 1), own.count("/") + own.count("_"),
    ]
    return [min(BINS - 1, n) for n in numbers]


N_FEATURES = 37


# ---- what the trees learn from ----


def _with_luhn(digits: str) -> str:
    return next(d for d in (digits[:-1] + str(k) for k in range(10)) if luhn(d))


def _number(rnd: random.Random, n: int) -> str:
    return str(rnd.randint(1, 9)) + "".join(rnd.choice("0123456789") for _ in range(n - 1))


def made(rnd: random.Random, kind: int) -> str:
    """A base form of a kind, with made-up values."""
    if kind == 0:
        word = lambda: "".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.randint(2, 9)))
        return f"{word()}{rnd.choice(['', '.', '_', '-'])}{rnd.choice([word(), str(rnd.randint(1, 99))])}@{word()}.{rnd.choice(['com', 'org', 'net', 'de', 'fr', 'co.uk', 'example.com', 'io'])}"
    if kind == 1:
        return ".".join(str(rnd.randint(0, 255)) for _ in range(4))
    if kind == 2:
        return _with_luhn(rnd.choice("3456") + _number(rnd, rnd.choice((12, 14, 15, 15, 15, 15, 17))))
    n = _number(rnd, 10)
    return f"+{rnd.randint(1, 99)} {rnd.choice([f'({n[:3]}) {n[3:6]}-{n[6:]}', f'{n[:3]} {n[3:6]} {n[6:]}', f'{n[:2]} {n[2:]}'])}"


def loosened(rnd: random.Random, kind: int, base: str) -> str:
    """A form of a base span that its pattern does not match as a whole."""
    if kind == 0:
        at, dot = rnd.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", "."), ("(at)", "."), (" {at} ", " {dot} "), (" [at] ", "."), (" @ ", " . "), (" AT ", " DOT ")])
        local, _, domain = base.rpartition("@")
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return base.replace(".", rnd.choice([" . ", "[.]", "(.)", " [.] ", " dot "]))
    if kind == 2:
        d = _digits(base)
        if len(d) < 16 and rnd.random() < 0.4:
            return d
        groups = [d[:4], d[4:10], d[10:]] if len(d) == 15 else [d[i : i + 4] for i in range(0, len(d), 4)]
        return rnd.choice([".", "_", "/", "  ", " - ", *([" ", "-"] if len(d) < 16 else [])]).join(groups)
    d = _digits(base)[-10:]
    a, b, c = d[:3], d[3:6], d[6:]
    return rnd.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00 {rnd.randint(1, 99)} {a} {b} {c}", f"0{a}/{b}{c}", f"{a} {b} {c}", f"({a}){b}-{c}", f"1-{a}-{b}-{c}", d])


def secret(rnd: random.Random) -> tuple[str, str]:
    """What stands before a made secret, and the secret."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda of, n: "a1" + "".join(rnd.choice(of) for _ in range(n - 2))
    if rnd.random() < 0.3:
        return rnd.choice(["", "use "]), rnd.choice(PREFIXES) + draw(letters, rnd.randint(16, 36))
    cue = rnd.choice(CUES["secret"])
    own = draw("0123456789abcdef", rnd.choice((32, 40, 48, 64))) if rnd.random() < 0.6 else draw(letters, rnd.randint(20, 44))
    return rnd.choice([f'{cue} = "', f"{cue}: ", f"{cue}=", f"{cue} = '", f'"{cue}": "']), own


def look_alike(rnd: random.Random) -> str:
    """What a generator may take for personal data, but is none."""
    n, two = lambda k: _number(rnd, k), lambda: f"{rnd.randint(1, 28):02d}"
    year, sep = str(rnd.randint(1950, 2049)), rnd.choice(".-/ ")
    bad = next(d for d in iter(lambda: n(16), "") if not luhn(d))
    short = next(d for d in iter(lambda: n(rnd.randint(13, 15)), "") if not luhn(d))
    hexes = "b2" + "".join(rnd.choice("0123456789abcdef") for _ in range(rnd.choice((30, 38, 62))))
    word = lambda: "".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randint(4, 9)))
    return rnd.choice([
        f"{year}{sep}{two()}{sep}{two()}", f"{two()}{sep}{two()}{sep}{year}", f"{year}{two()}{two()}{two()}{two()}", f"isbn 978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", f"id {n(rnd.randint(7, 15))}", n(rnd.randint(7, 12)), f"order no {n(10)}",
        f"{n(2)} {n(3)} {n(3)}", f"{n(1)} {n(3)} {n(3)} {n(3)}", f"{year}-{year}", f"{n(3)}.{n(2)} {n(3)}.{n(2)}", f"{n(2)} {n(2)} {n(2)} {n(2)}", f"v {rnd.randint(1, 9)} . {rnd.randint(0, 20)} . {rnd.randint(0, 9)} . {rnd.randint(1000, 4000)}",
        " . ".join(str(rnd.randint(256, 999)) for _ in range(4)), ". ".join(str(rnd.randint(1, 99)) for _ in range(4)), bad, f"{bad[:4]}.{bad[4:8]}.{bad[8:12]}.{bad[12:]}", f"{bad[:4]} - {bad[4:8]} - {bad[8:12]} - {bad[12:]}", f"{bad[:4]}_{bad[4:8]}_{bad[8:12]}_{bad[12:]}",
        short, f"{short[:4]}-{short[4:8]}-{short[8:]}", f"{n(2)} @ {n(1)}.{n(2)}", f"{word()} @ {n(1)}.{n(2)}", f"look at {word()}. {word()}", f"{word()} at {word()} . {word()}", f"{word()} at {word()}.", f"@{word()}", f"{word()}@{word()}",
        f"commit {hexes}", f"sha {hexes}", f"digest: {hexes}", f"checksum = {hexes}", f"/{word()}/{word()}-{word()}/{word()}{n(2)}.png", f"{word()}_{word()}_{word()}_{n(3)}", f"{word()}-{word()}-{word()}-{n(1)}", "a" * rnd.randint(18, 30) + "1", f"file {hexes}",
    ])


def _hopeless(text: str, span: Span) -> bool:
    """A candidate that its kind rules out."""
    kind, s, e = span
    own = text[s:e]
    digits = _digits(own)
    if kind == 1:
        return not _octets(".".join(re.findall(r"[0-9]+", own)))
    return (kind == 2 and not luhn(digits)) or (kind == 3 and own == digits and not any(w in CUES["phone"] for w in re.findall(r"[^\W\d_]+", text[max(0, s - 40) : s].lower())[-3:]))


def lessons(text: str, seed: int) -> Iterator[tuple[str, Span | None, list[Span]]]:
    """Stretches of a text with one planted thing each: the stretch, the span that is right (none for a look-alike), the candidates there."""
    rnd = random.Random(seed)
    base = base_spans(text)
    places = [m.start() for m in re.finditer(r"\s", text)] or [len(text)]

    def around(put: Callable[[], tuple[str, str]], s: int, e: int, kind: int) -> tuple[str, Span | None, list[Span]]:
        lead, own = put()
        left = text[max(0, s - AROUND) : s]
        shown = f"{left}{lead}{own}{text[e : e + AROUND]}"
        start, end = len(left) + len(lead), len(left) + len(lead) + len(own)
        met = [c for c in candidates(shown) if c[1] < end and start < c[2]]
        return shown, None if kind < 0 else (kind, start, end), met

    for k, s, e in rnd.sample(base, min(len(base), PLANTED)):
        yield around(lambda k=k, s=s, e=e: ("", loosened(rnd, k, text[s:e])), s, e, k)
    for _ in range(PLANTED):
        at, k = rnd.choice(places), rnd.randrange(len(ALL_KINDS))
        if k == 4:
            yield around(lambda: (lambda lead, own: (f" {lead}", own))(*secret(rnd)), at, at, 4)
        else:
            own = loosened(rnd, k, made(rnd, k))
            cue = rnd.random() < 0.5 or own.isdigit()  # a bare number says nothing by itself
            yield around(lambda k=k, own=own, cue=cue: (f" {rnd.choice(CUES[ALL_KINDS[k]]) + rnd.choice([' ', ': ']) if cue else ''}", own), at, at, k)
    for _ in range(PLANTED):
        at = rnd.choice(places)
        yield around(lambda: (" ", look_alike(rnd)), at, at, -1)


def _apart(spans: list[Span]) -> Callable[[Span], bool]:
    """Whether a span overlaps none of those given, which may overlap each other."""
    by_start = sorted(spans, key=lambda c: c[1])
    starts, ends = [c[1] for c in by_start], list(accumulate((c[2] for c in by_start), max))

    def apart(c: Span) -> bool:
        before = bisect_left(starts, c[2])
        return not before or ends[before - 1] <= c[1]

    return apart


class SpanModel:
    def __init__(self, trees: BoostedTrees, thresholds: tuple[float, ...]):
        self.trees, self.thresholds = trees, thresholds

    def spans(self, texts: list[str], bases: list[list[Span]]) -> list[list[Span]]:
        """For each text its base spans and the candidates that are added, by kind, then start; better scores first, ties to the longer, then the earlier."""
        rest = [list(filter(_apart(b), candidates(t, b))) for t, b in zip(texts, bases, strict=True)]
        x = np.array([features(t, c) for t, r in zip(texts, rest, strict=True) for c in r], np.int64).reshape(-1, N_FEATURES)
        scores, at, out = self.trees.probability(x).tolist(), 0, []
        for base, own in zip(bases, rest, strict=True):
            added: list[tuple[int, int, int]] = []  # start, end, kind; none overlaps another
            for p, c in sorted(zip(scores[at : at + len(own)], own, strict=True), key=lambda x: (-x[0], x[1][1] - x[1][2], x[1])):
                k = bisect_left(added, (c[1], c[2], c[0]))
                if p >= self.thresholds[c[0]] and (k == 0 or added[k - 1][1] <= c[1]) and (k == len(added) or added[k][0] >= c[2]):
                    added.insert(k, (c[1], c[2], c[0]))
            at += len(own)
            out.append(sorted([*base, *((k, s, e) for s, e, k in added)]))
        return out


def fit(docs: DataFrame, documents: int = FIT_DOCUMENTS) -> SpanModel:
    """docs (doc_id, text): at most `documents` of them are read; repeated ids teach by their smallest text. No document, no added span."""
    known = docs.where("doc_id is not null and text is not null")
    ids = bounded(known.select("doc_id").distinct(), documents, "doc_id")
    sample = known.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, labels, folds = [], [], []

            def learn(text: str, c: Span, label: bool, fold: int) -> None:
                rows.append(features(text, c))
                labels.append(int(label))
                folds.append(fold)

            for key, text in zip(b.column(0).to_pylist(), values_of(b.column(1)), strict=True):
                fold = zlib.crc32(str(key).encode()) % 2
                base = base_spans(text)
                for c in base[:PLANTED]:
                    learn(text, c, True, fold)
                given = set(base)
                hopeless = [c for c in candidates(text, base) if c not in given and _hopeless(text, c)]
                for c in hopeless[: 2 * PLANTED]:
                    learn(text, c, False, fold)
                for shown, right, met in lessons(text, zlib.crc32(text.encode("utf-8", "surrogatepass"))):
                    for c in met:
                        learn(shown, c, c == right, fold)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64())), pa.array(labels, pa.int64()), pa.array(folds, pa.int64())], ["x", "y", "fold"])

    seen = sample.mapInArrow(run, "x array<bigint>, y bigint, fold bigint").groupBy("x", "y", "fold").agg(F.count("*").alias("n")).orderBy("x", "y", "fold").toArrow()
    x = seen.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, N_FEATURES)
    y, fold, often = (seen.column(c).to_numpy().astype(np.int64) for c in ("y", "fold", "n"))
    x, y, fold = np.repeat(x, often, axis=0), np.repeat(y, often).astype(np.float64), np.repeat(fold, often)
    trees = fit_trees(x[fold == 0], y[fold == 0], ROUNDS, DEPTH)
    p, kind, truth = trees.probability(x[fold == 1]), x[fold == 1, 0], y[fold == 1]
    thresholds = []
    for k in range(len(ALL_KINDS)):
        order = np.argsort(-p[kind == k], kind="stable")
        score, good = p[kind == k][order], truth[kind == k][order]
        precise = np.flatnonzero(np.cumsum(good) / np.arange(1, len(good) + 1) >= PRECISION) if len(good) else []
        thresholds.append(max(0.5, float(score[precise[-1]])) if len(precise) else 2.0)
    return SpanModel(trees, tuple(thresholds))


def written(spans: list[Span]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_personal_data(docs: DataFrame, model: SpanModel) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 (of the base spans), spans (all of the four kinds), n_added, secrets, n_found (spans and secrets).

    Code points, end exclusive. A null text is empty and holds nothing;
    repeated rows each get their own; other columns of docs are not looked at.
    """
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "secrets", "n_found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names[1:]]
            for i in range(0, b.num_rows, TOGETHER):
                texts = [t or "" for t in b.column(1).slice(i, TOGETHER).to_pylist()]
                bases = list(map(base_spans, texts))
                for base, spans in zip(bases, model.spans(texts, bases), strict=True):
                    own, hidden = [c for c in spans if c[0] < len(KINDS)], [c for c in spans if c[0] >= len(KINDS)]
                    values = *(sum(k == j for k, _, _ in base) for j in range(len(KINDS))), hashlib.sha256(written(base).encode()).hexdigest(), written(own), len(own) - len(base), written(hidden), len(spans)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            kinds = *([pa.int64()] * len(KINDS)), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema_with(docs.select("doc_id"), **{f"n_{k}": "long" for k in KINDS}, base_sha256="string", spans="string", n_added="long", secrets="string", n_found="long"))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: x[1:]):
        if e > at:
            out += [text[at:s], f"[{ALL_KINDS[k]}]"] if s >= at else []
            at = e
    return "".join([*out, text[at:]])


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of `documents`, by `find_personal_data` with a model fitted on a bounded sample of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_personal_data(docs, fit(docs))
