"""Operator 4: personal data by weak supervision.

Candidate spans come from the fixed rules (emails, IP addresses, cards, phone numbers) and from looser shapes (near
misses of those, social security numbers, IBANs, titled names). Six labelers - strict rule, checksum, gazetteer,
context, boundaries and shape - each vote personal, not personal or nothing. Expectation-maximisation over the counts
of vote patterns of the whole corpus estimates every labeler's reliability and the patterns' posteriors. With those as
soft labels a logistic classifier of spans is trained on what the labelers don't look at one by one: the signs of the
span, the signs beside it and the words before it. Newton's method gathers its sums from all spans of the corpus.
Spans of the fixed rules are always kept; the classifier decides on the others. Vote patterns and features are bounded
in number, so what reaches the driver is too.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, needs
from .spans import Taken, base_of, count_of, digest, joined

KINDS = ["email", "ip", "card", "phone", "card_like", "phone_like", "ssn", "iban", "name"]
LOCAL = "A-Za-z0-9._%+-"
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
#: A match can only begin where a run of the first class begins, or directly behind the match before.
EMAIL_AT_RUN = re.compile(rf"(?<![{LOCAL}]){_EMAIL}")
EMAIL_HERE = re.compile(_EMAIL)
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
PHONE_LIKE = re.compile(r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20[A-Z][a-zà-ÿ]{1,30}(?:\x20[A-Z][a-zà-ÿ]{1,30})?")
DIGIT = re.compile("[0-9]")
WORD = re.compile(r"[^\W\d_]+")
#: Gazetteers (fixed values).
TOP_DOMAINS = frozenset("com org net edu gov io co info biz dev app me us uk de fr es it nl eu ch at be pt pl se no dk fi cz ie ca au nz jp cn in br mx ar ru za".split())
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "36", "38", "35", "2221", "2720")
RESERVED_IP = ("0.", "127.", "255.", "10.", "192.168.", "169.254.")
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "64", "81", "82", "86", "90", "91")
FIRST_NAMES = frozenset(
    "James Mary John Anna Robert Linda Michael David Maria Peter Paul Laura Thomas Sarah Hans Jürgen Sophie Marie Pierre Jean Carlos José Ana Luis "
    "Emma Noah Olivia Liam Ava Ethan Grace Henry Alice Jack Lucy Oscar Emily Daniel Julia Martin Clara Felix Lena Lukas Max Paula Karl Heinz Klaus "
    "Ursula Monika Sabine Petra Wolfgang Stefan Andreas Claire Luc Camille Louis Chloé Hugo Manon Jules Élise René Michel Nathalie Isabelle Juan "
    "Carmen Miguel Lucía Pablo Sofía Diego Elena Javier Marta Pedro Isabel Antonio Rosa Manuel Pilar George William Charles Elizabeth Patricia "
    "Jennifer Susan Jessica Karen Nancy Lisa Betty Mark Donald Steven Andrew Kevin Brian Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary".split()
)
FOR = re.compile(r"\b(?:e-?mail|mail|contact|phone|tel|telephone|mobile|call|fax|card|visa|mastercard|credit|ssn|social security|iban|account|konto|ip|address|adresse|name|tarjeta|tel[eé]fono|carte)\b", re.IGNORECASE)
AGAINST = re.compile(r"\b(?:version|order|invoice|isbn|sku|serial|item|page|section|chapter|issue|ticket|build|release|figure|id)\b", re.IGNORECASE)
CONTEXT_SIGNS = 40
LABELERS = ["rule", "checksum", "gazetteer", "context", "boundary", "shape"]
#: Where a labeler starts in expectation-maximisation, and pseudo-counts that keep it from collapsing.
START_ACCURACY, PSEUDO = 0.8, 2.0
#: Share of personal spans to start from, of loose and strict kinds; the first kinds are the strict ones.
START_PRIOR, STRICT_KINDS = (0.2, 0.9), 4
EM_ROUNDS, FIT_ROUNDS, RIDGE = 50, 25, 1.0
ACCEPT = 0.5
LOGIT = float(np.log(ACCEPT / (1 - ACCEPT)))
SPAN = "struct<start:int,kind:int,end:int,base:boolean,pattern:int,features:array<int>>"
#: Signs as the classifier sees them, and its features' numbers: a block for each question, one number an answer.
LENGTHS = (6, 10, 14, 18, 24, 40)
WORD_NUMBERS = 64


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping matches, in time linear in the text."""
    out, at = [], 0
    while m := (out and EMAIL_HERE.match(text, at)) or EMAIL_AT_RUN.search(text, at):
        out.append(m.span())
        at = m.end()
    return out


def proposals(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base): the fixed rules' matches, then the looser shapes that overlap none of them."""
    out: list[tuple[int, int, int, bool]] = []
    if "@" in text:
        out += [(a, 0, b, True) for a, b in emails(text)]
    near: list[tuple[int, int, int, bool]] = []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x := p.lstrip("0")) <= 3 and int(x or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end(), True))
        for m in CARD.finditer(text):
            n = len(d := digits_of(m[0]))
            if 14 <= n <= 19:
                if luhn(d):
                    out.append((m.start(), 2, m.end(), True))
                else:
                    near.append((m.start(), 4, m.end(), False))
        if "+" in text:
            out += [(m.start(), 3, m.end(), True) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
        for kind, pattern in ((5, PHONE_LIKE), (6, SSN), (7, IBAN)):
            near += [(m.start(), kind, m.end(), False) for m in pattern.finditer(text)]
    near += [(m.start(), 8, m.end(), False) for m in NAME.finditer(text)]
    if near:
        taken, last = Taken([(a, b) for a, _, b, _ in out]), 0
        for a, k, b, base in sorted(near):
            if last <= a and taken.leaves(a, b):
                out.append((a, k, b, base))
                last = b
    return out


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(text: str, start: int, kind: int, end: int, base: bool) -> list[int]:
    """A vote of each labeler: 2 personal, 1 not personal, 0 none."""
    s = text[start:end]
    d = digits_of(s)
    name = KINDS[kind]
    rule = 2 if base else 0
    if name in ("card", "card_like"):
        checksum = 2 if luhn(d) else 1
        gazetteer = 2 if d.startswith(CARD_PREFIXES) else 0
    elif name == "ip":
        checksum = 2
        gazetteer = 1 if s.startswith(RESERVED_IP) else 0
    elif name == "email":
        checksum = 0
        gazetteer = 2 if s.rpartition(".")[2].lower() in TOP_DOMAINS else 1
    elif name in ("phone", "phone_like"):
        checksum = 2 if 10 <= len(d) <= 15 else 1
        gazetteer = 2 if name == "phone" and d.startswith(COUNTRY_CODES) else 0
    elif name == "ssn":
        checksum = 1 if d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000" else 2
        gazetteer = 0
    elif name == "iban":
        checksum, gazetteer = (2 if _iban_ok(s) else 1), 0
    else:
        checksum, gazetteer = 0, 2 if FIRST_NAMES & set(s.split()) else 0
    before = text[max(0, start - CONTEXT_SIGNS) : start]
    context = 2 if FOR.search(before) else 1 if AGAINST.search(before) else 0
    beside = text[max(0, start - 1) : start] + text[end : end + 1]
    boundary = 1 if any(c.isalnum() or c in "_/=#" for c in beside) else 2
    shape = 1 if len(d) >= 9 and (len(set(d)) <= 2 or d in "01234567890123456789") else 0
    return [rule, checksum, gazetteer, context, boundary, shape]


def pattern_of(kind: int, cast: list[int]) -> int:
    code = kind
    for v in cast:
        code = code * 3 + v
    return code


def pattern_parts(code: int) -> tuple[int, list[int]]:
    cast = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        cast.append(v)
    return code, cast[::-1]


def estimate_reliabilities(counts: dict[int, int]) -> tuple[dict[int, float], np.ndarray]:
    """Dawid and Skene's model of two classes with abstention: posteriors by pattern; the probabilities of
    the votes by class and labeler. Labelers are as reliable for every kind, so what strict kinds teach carries over
    to loose ones; the share of personal spans is each kind's own."""
    codes = sorted(counts)
    kinds = np.array([pattern_parts(c)[0] for c in codes])
    cast = np.array([pattern_parts(c)[1] for c in codes]).reshape(len(codes), len(LABELERS))
    n = np.array([counts[c] for c in codes], dtype=float)
    right, wrong = START_ACCURACY, 1 - START_ACCURACY
    start = np.tile(np.array([[1 / 3, right * 2 / 3, wrong * 2 / 3], [1 / 3, wrong * 2 / 3, right * 2 / 3]])[:, None, :], (1, len(LABELERS), 1))
    table = start.copy()
    first = np.array([START_PRIOR[k < STRICT_KINDS] for k in range(len(KINDS))])
    prior, posterior = first.copy(), np.full(len(codes), 0.5)
    for _ in range(EM_ROUNDS):
        log = np.log(table[:, np.arange(len(LABELERS))[None, :], cast]).sum(-1)  # class, pattern
        joint = log + np.log(np.stack([1 - prior[kinds], prior[kinds]]))
        posterior = 1 / (1 + np.exp(np.clip(joint[0] - joint[1], -60, 60)))
        table = start * PSEUDO
        for j in range(len(LABELERS)):
            for c, weight in enumerate((n * (1 - posterior), n * posterior)):
                np.add.at(table, (c, j, cast[:, j]), weight)
        table /= table.sum(-1, keepdims=True)
        prior = (np.bincount(kinds, n * posterior, len(KINDS)) + PSEUDO * first) / (np.bincount(kinds, n, len(KINDS)) + PSEUDO)
    return dict(zip(codes, posterior.tolist(), strict=True)), table


def _sign(c: str) -> int:
    """Class of a sign beside or at the edge of a span (none, digit, capital, small letter, space, opening, closing, other)."""
    if not c:
        return 0
    if c.isdigit():
        return 1
    if c.isalpha():
        return 2 if c.isupper() else 3
    return 4 if c.isspace() else 5 if c in "([<{\"'" else 6 if c in ")]>}.,;:!?" else 7


def _blocks() -> list[int]:
    kinds = len(KINDS)
    return [kinds, kinds * (len(LENGTHS) + 1), kinds * 4, kinds * 8, 8, 8, 8, 8, 3, WORD_NUMBERS + 1]


FIRST_OF = np.cumsum([1, *_blocks()]).tolist()
FEATURES = FIRST_OF.pop()


def features_of(text: str, start: int, kind: int, end: int) -> list[int]:
    """The numbers of the features that a span has: its kind, length, share of digits and separators, by kind; its
    first and last sign, the signs beside it, whether words before it speak for or against it, and the last of them."""
    s = text[start:end]
    digits = sum(map(str.isdigit, s))
    separators = ("-" in s) + 2 * (" " in s) + 4 * ("." in s)
    before = text[max(0, start - CONTEXT_SIGNS) : start]
    spoken = 1 if FOR.search(before) else 2 if AGAINST.search(before) else 0
    words = WORD.findall(before)
    last = 1 + zlib.crc32(words[-1].lower().encode()) % WORD_NUMBERS if words else 0
    answers = [kind, kind * (len(LENGTHS) + 1) + bisect_left(LENGTHS, len(s)), kind * 4 + min(3, 4 * digits // len(s)), kind * 8 + separators, _sign(s[0]), _sign(s[-1]), _sign(text[start - 1 : start] if start else ""), _sign(text[end : end + 1]), spoken, last]
    return [0, *(first + x for first, x in zip(FIRST_OF, answers, strict=True))]


def train_classifier(spans: DataFrame, posterior: dict[int, float]) -> np.ndarray:
    """Ridge logistic regression on the soft labels of all ``spans`` (pattern, features), by Newton's method; each step
    sums gradient and curvature over the corpus."""
    w = np.zeros(FEATURES)
    if not posterior:
        return w
    labels = spans.sparkSession.sparkContext.broadcast(posterior)
    same = cut(spans.groupBy("pattern", "features").agg(F.count("*").cast("double").alias("n")), "pii-spans")

    def sums_at(w: np.ndarray):
        def run(batches):
            gradient, curvature = np.zeros(FEATURES), np.zeros((FEATURES, FEATURES))
            for batch in batches:
                y = np.array([labels.value[p] for p in batch.column("pattern").to_pylist()])
                x = np.zeros((batch.num_rows, FEATURES))
                at = batch.column("features").to_pylist()
                x[np.repeat(np.arange(len(at)), [len(f) for f in at]), [i for f in at for i in f]] = 1
                n, p = batch.column("n").to_numpy(), 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                gradient += x.T @ (n * (p - y))
                curvature += (x * (n * p * (1 - p))[:, None]).T @ x
            flat = np.concatenate([gradient, curvature.ravel()])
            seen = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(flat[seen])], ["at", "x"])

        return run

    for _ in range(FIT_ROUNDS):
        flat = np.zeros(FEATURES + FEATURES**2)
        for r in same.mapInArrow(sums_at(w), "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():  # features squared at most
            flat[r["at"]] = r["x"]
        step = np.linalg.solve(flat[FEATURES:].reshape(FEATURES, FEATURES) + RIDGE * np.eye(FEATURES), flat[:FEATURES] + RIDGE * w)
        w -= step
        if np.abs(step).max() < 1e-3:
            break
    return w.round(6)


def learn(spans: DataFrame) -> np.ndarray:
    """The classifier's weights from all ``spans`` (pattern, features); a span is personal where theirs sum to more
    than ``ACCEPT``'s logit."""
    counts = {r["pattern"]: r["count"] for r in spans.groupBy("pattern").count().collect()}  # at most kinds x 3^labelers rows
    return train_classifier(spans, estimate_reliabilities(counts)[0] if counts else {})


def _scan(batch: pa.RecordBatch) -> list[list[dict]]:
    out = []
    for t in batch.column("text").to_pylist():
        out.append([{"start": a, "kind": k, "end": b, "base": base, "pattern": pattern_of(k, votes(t, a, k, b, base)), "features": features_of(t, a, k, b)} for a, k, b, base in proposals(t)] if t else [])
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("pattern", pa.int32()), ("features", pa.list_(pa.int32()))]))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for each row of ``docs`` (doc_id, text).

    A null text is empty and has no spans; repeated rows are reported each; other columns are left out.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scan(batch), _SPANS)], ["doc_id", "found"])

    found = cut(map_batches(needs(docs, "doc_id", "text"), run, f"doc_id long, found array<{SPAN}>"), "pii")
    weights = learn(found.select(F.explode("found").alias("s")).select("s.pattern", "s.features"))
    table = F.array(*[F.lit(float(x)) for x in weights])
    logit = lambda s: F.aggregate(s["features"], F.lit(0.0), lambda sum_, i: sum_ + F.element_at(table, i + 1))
    kept = found.withColumn("kept", F.filter("found", lambda s: s["base"] | (logit(s) >= LOGIT)))
    return kept.select(
        "doc_id",
        *[count_of(F.col("kept"), k).alias(f"n_{KINDS[k]}") for k in range(4)],
        digest(joined(base_of(F.col("kept")), KINDS)).alias("base_sha256"),
        joined(F.transform("kept", lambda s: F.struct(s["start"], s["kind"], s["end"])), KINDS).alias("spans"),
        F.size(F.filter("kept", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` (columns of documents) with every kept span of a text replaced by its kind in brackets, n_chars renewed.

    The spans are found in a first pass for the classifier only; the second finds them again beside the text, which
    costs less than carrying texts through scratch space. Null texts stay null; where there is no n_chars none is added.
    Other columns stay as they are.
    """

    def spans(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [s for spans in _scan(batch) for s in spans]
        return pa.RecordBatch.from_arrays([pa.array([s["pattern"] for s in found], pa.int32()), pa.array([s["features"] for s in found], pa.list_(pa.int32()))], ["pattern", "features"])

    weights = learn(cut(map_batches(needs(docs, "text"), spans, "pattern int, features array<int>"), "pii"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, changed = batch.column("text").to_pylist(), []
        for t, spans in zip(texts, _scan(batch), strict=True):
            parts, at = [], 0
            for s in sorted((s for s in spans if s["base"] or sum(weights[i] for i in s["features"]) >= LOGIT), key=lambda s: (s["start"], -s["end"])):
                if s["end"] > at:
                    parts += [t[at : max(at, s["start"])], f"[{KINDS[s['kind']]}]"]
                    at = s["end"]
            changed.append("".join([*parts, t[at:]]) if parts else t)
        columns = {n: batch.column(n) for n in batch.schema.names}
        columns["text"] = pa.array(changed, pa.string())
        if "n_chars" in columns:
            old = columns["n_chars"].to_pylist()
            columns["n_chars"] = pa.array([n if x is y else len(y) for n, x, y in zip(old, texts, changed, strict=True)], pa.int64()).cast(columns["n_chars"].type)
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return map_batches(docs, run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))
