"""Operator 2: secrets, by fixed rules and by a battery of randomness tests.

Candidates are runs of at least ``SHORTEST`` signs of the usual encodings. The encoding is inferred (hexadecimal,
base32, base36, base64), and three statistics measure departure from random symbols: chi-squared uniformity over the
alphabet, runs above and below its middle, and lag-1 serial correlation. The null hypothesis is a *structured* string
whose departure is at least a fixed effect; under it each statistic shifts with the length, so a short string can't
earn a small p-value. Stouffer's sum, divided by
its deviation under the statistics' correlation, combines the three. Benjamini-Hochberg runs in each stratum of length and
encoding over the candidates of the whole corpus, from a histogram of p-values of fixed size.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, needs
from .spans import SPAN, Taken, base_of, count_of, digest, joined

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs begin where no sign of the class stands before, which leaves the maximal runs and keeps the scan linear.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}")
SHORTEST = 24
#: The alphabets, in order of their symbols.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
ENCODINGS = list(ALPHABETS)
#: Least departure that a structured string is taken to have: excess of sum(p^2)*k over 1, and shifts per sqrt(length).
CHI_EFFECT, RUNS_EFFECT, SERIAL_EFFECT = 1.0, 0.5, 0.5
#: Runs and serial correlation both tell how a symbol depends on the one before it. For uniform symbols the correlation
#: of a symbol with its half of the alphabet is sqrt(3) / 2, so that of the two statistics is 3 / 4; the sum of all
#: three has this standard deviation.
DEVIATION = math.sqrt(3 + 2 * 0.75)
#: Upper bounds of the strata of length.
LENGTHS = (32, 48, 64, 1 << 30)
FALSE_DISCOVERY_RATE = 0.01
#: p-values are kept as floor(-LEVELS_PER_DECADE * log10 p), at most MAX_LEVEL.
LEVELS_PER_DECADE, MAX_LEVEL = 4, 120


def _normal_below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def inferred_encoding(s: str) -> str | None:
    """The narrowest alphabet that holds the string, if its mix of letters and digits is that of an encoding."""
    s = s.rstrip("=")
    digit, lower, upper = (any(a <= c <= b for c in s) for a, b in ("09", "az", "AZ"))
    if not digit or not (lower or upper):
        return None
    for name, alphabet in ALPHABETS.items():
        if name in ("base64", "base64url") and not (lower and upper):
            continue
        if set(s) <= set(alphabet):
            return name
    return None


def structured_p(s: str, encoding: str) -> float:
    """p-value of the battery under the null hypothesis of a structured string."""
    alphabet = ALPHABETS[encoding]
    k = len(alphabet)
    x = np.array([alphabet.index(c) for c in s.rstrip("=")])
    n = len(x)
    if n < 3:
        return 1.0
    counts = np.bincount(x, minlength=k)
    chi = float(((counts - n / k) ** 2).sum() * k / n)
    df, shift = k - 1, CHI_EFFECT * n
    # Sankaran's normal form of the noncentral chi-squared distribution
    m, v = df + shift, 2 * (df + 2 * shift)
    h = 1 - 2 * m * (df + 3 * shift) / (3 * (df + 2 * shift) ** 2)
    p = (df + 2 * shift) / m**2
    mm = (h - 1) * (1 - 3 * h)
    z_chi = ((chi / m) ** h - (1 + h * p * (h - 1 - 0.5 * (2 - h) * mm * p))) / (h * math.sqrt(2 * p) * (1 + 0.5 * mm * p)) if v else 0.0
    high = x >= k / 2
    n1 = int(high.sum())
    n0 = n - n1
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 1 + 2 * n0 * n1 / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    z_runs = (abs(runs - mean) / math.sqrt(var) if var > 0 else math.sqrt(n)) - RUNS_EFFECT * math.sqrt(n)
    d = x - x.mean()
    square = float((d * d).sum())
    serial = abs(float((d[1:] * d[:-1]).sum()) / square + 1 / n) * math.sqrt(n) if square else math.sqrt(n)
    z_serial = serial - SERIAL_EFFECT * math.sqrt(n)
    worst = max(z_chi, z_runs, z_serial)
    return _normal_below(worst if worst > 0 else (z_chi + z_runs + z_serial) / DEVIATION)  # one test that speaks for structure decides


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the fixed rules: leftmost, non-overlapping for each kind; failing matches dropped."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def scan(text: str) -> list[dict]:
    base = base_spans(text)
    out = [{"start": a, "kind": k, "end": b, "base": True, "group": 0, "level": 0} for a, k, b in base]
    taken = Taken([(a, b) for a, _, b in base])
    for m in CANDIDATE.finditer(text):
        if not (encoding := inferred_encoding(m[0])):
            continue
        if not taken.leaves(m.start(), m.end()):
            continue
        p = structured_p(m[0], encoding)
        level = min(MAX_LEVEL, int(-LEVELS_PER_DECADE * math.log10(max(p, 1e-300))))
        stratum = next(i for i, most in enumerate(LENGTHS) if len(m[0]) < most)
        out.append({"start": m.start(), "kind": 3, "end": m.end(), "base": False, "group": ENCODINGS.index(encoding) * len(LENGTHS) + stratum, "level": level})
    return out


def discovery_levels(histogram: dict[int, dict[int, int]], rate: float = FALSE_DISCOVERY_RATE) -> dict[int, int]:
    """Benjamini-Hochberg by stratum: the lowest level (largest p) such that p * all / discoveries stays within the rate."""
    out = {}
    for group, levels in histogram.items():
        total, found = sum(levels.values()), 0
        for level in sorted(levels, reverse=True):
            found += levels[level]
            if 10 ** (-level / LEVELS_PER_DECADE) * total <= rate * found:
                out[group] = level
    return out


def find_secrets(docs: DataFrame, rate: float = FALSE_DISCOVERY_RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for each row of ``docs`` (doc_id, text).

    A null text is empty and has no spans; repeated rows are reported each; other columns are left out.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [scan(t or "") for t in batch.column("text").to_pylist()]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("group", pa.int32()), ("level", pa.int32())]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "found"])

    found = cut(map_batches(needs(docs, "doc_id", "text"), run, f"doc_id long, found array<{SPAN}>"), "secrets")
    histogram: dict[int, dict[int, int]] = {}
    candidates = found.select(F.explode(F.filter("found", lambda s: ~s["base"])).alias("s"))
    for r in candidates.groupBy("s.group", "s.level").count().collect():  # at most strata x levels rows
        histogram.setdefault(r["group"], {})[r["level"]] = r["count"]
    least = discovery_levels(histogram, rate)
    needed = F.array(*[F.lit(least.get(g, MAX_LEVEL + 1)) for g in range(len(ENCODINGS) * len(LENGTHS))])
    kept = F.filter("found", lambda s: s["base"] | (s["level"] >= F.element_at(needed, s["group"] + 1)))
    return found.withColumn("kept", kept).select(
        "doc_id",
        count_of(F.col("kept"), 0).alias("n_assign"),
        count_of(F.col("kept"), 1).alias("n_access"),
        count_of(F.col("kept"), 2).alias("n_hex"),
        digest(joined(base_of(F.col("kept")), KINDS)).alias("base_sha256"),
        joined(F.col("kept"), KINDS).alias("spans"),
        F.size(F.filter("kept", lambda s: ~s["base"])).cast("long").alias("n_random"),
    )
