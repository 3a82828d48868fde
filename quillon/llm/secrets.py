"""Secret scans: fixed patterns, then a randomness battery over long tokens.

Every long token outside the patterns' spans gets the smallest encoding that
has all its symbols; base64 and hex that decode to readable text are ordinary.
Three tests ask whether a token is random in its encoding: chi-squared
uniformity of the alphabet, runs about the alphabet's middle, serial
correlation of neighbours. Alphabets are ordered so that the middle parts what
text keeps apart (capitals from small letters, vowels and digits from
consonants). The three results are one score: the logarithm of how much
likelier ordinary tokens give them than random ones do. The tests share
symbols, so means and covariances come from simulated tokens, by encoding and
length. Ordinary ones are names, paths and numbers, made of words that a chain
of letter triples gives; the triples are counted over all documents.

A token's p-value is the chance that an ordinary token has so low a score (of
several kinds of names the worst counts); a token that VETO of random ones
would not be like is no secret. Weighted Benjamini-Hochberg (weights in
proportion to length) holds the share of false finds over all tokens of all
documents. One pass over the texts counts triples and tests tokens, the next
applies the cuts.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import carried, stash

# The three patterns of the contract. hex and access in a form
# that only matches what is long enough, which finds the same spans.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

#: Tokens of so many symbols are tested.
SHORTEST = 20
LONG = re.compile(r"[A-Za-z0-9+/_-]{20,}")
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SOFT = "aeiouylr"
HARD = "".join(c for c in LOWER if c not in SOFT)
#: Alphabets, smallest first.
ENCODINGS = [
    DIGITS + "abcdef",
    DIGITS + "ABCDEF",
    "234567" + SOFT.upper() + "HN" + "".join(c for c in HARD.upper() if c not in "HN"),
    DIGITS + SOFT + HARD,
    DIGITS + SOFT.upper() + HARD.upper(),
    UPPER + DIGITS + LOWER,
    UPPER + DIGITS + "+/" + LOWER,
    UPPER + DIGITS + "-_" + LOWER,
]
PLACE = np.full((len(ENCODINGS), 128), -1, "i8")
for _k, _alphabet in enumerate(ENCODINGS):
    PLACE[_k, np.frombuffer(_alphabet.encode(), "u1")] = np.arange(len(_alphabet))
#: A hex number in groups (as of a UUID) is tested without its hyphens.
GROUPED = re.compile(r"[0-9a-f]+(?:-[0-9a-f]+)+|[0-9A-F]+(?:-[0-9A-F]+)+")
#: Lengths that have distributions of their own; a token takes the longest that is no longer than it.
LENGTHS = np.array([16, 20, 22, 24, 26, 28, 32, 36, 40, 48, 64, 96, 160])
#: Simulated tokens of each kind; the share of random ones that may fail; the share of false finds.
SIMULATED, VETO, RATE = 2000, 1e-3, 0.01
#: Scores are counted in classes of STEP from LOWEST on; what is above the last class is in it.
LOWEST, STEP, CLASSES = -20.0, 0.05, 800
HIGHEST = LOWEST + STEP * CLASSES
#: The share of simulated tokens beyond which a tail is carried on as a power.
TAIL = 0.02
#: Letters of the chain: 0 stands between words.
FOLD = np.zeros(256, "i8")
for _c in range(26):
    FOLD[65 + _c] = FOLD[97 + _c] = _c + 1


def battery(values: np.ndarray, m: int) -> np.ndarray:
    """(uniformity, runs, serial correlation) of each row of symbols (0 to m - 1), each about standard normal where they are random."""
    k, n = values.shape
    count = np.bincount((np.arange(k)[:, None] * m + values).ravel(), minlength=k * m).reshape(k, m).astype("f8")
    chi, df = (count * count).sum(axis=1) * m / n - n, m - 1
    part = math.sqrt(2 / (9 * df))  # Wilson and Hilferty's approximation
    uniform = ((np.maximum(chi, 0) / df) ** (1 / 3) - 1 + part * part) / part
    above, share = 2 * values >= m, (m // 2) / m
    other = 2 * share * (1 - share)
    runs = ((above[:, 1:] != above[:, :-1]).sum(axis=1) - (n - 1) * other) / math.sqrt((n - 1) * other * (1 - other))
    d = values - (m - 1) / 2
    serial = (d[:, 1:] * d[:, :-1]).sum(axis=1) * 12 / (m * m - 1) / math.sqrt(n - 1)
    return np.stack([uniform, runs, serial], axis=1)


def _readable(token: str, kind: int) -> bool:
    """The token decodes, as hex or base64, to what is nearly all printable ASCII."""
    try:
        if kind < 2:
            raw = bytes.fromhex(token[: len(token) // 2 * 2])
        else:
            raw = base64.b64decode(token.translate({45: "+", 95: "/"})[: len(token) // 4 * 4], validate=True)
    except ValueError:
        return False
    return bool(raw) and sum(32 <= b < 127 for b in raw) >= 0.9 * len(raw)


def examine(token: str) -> tuple[int, int, np.ndarray] | None:
    """(encoding, number of its length in LENGTHS, battery); None for digits, readable codes and no encoding."""
    if GROUPED.fullmatch(token):
        token = token.replace("-", "")
    if token.isdigit() or len(token) < LENGTHS[0]:
        return None
    raw = np.frombuffer(token.encode(), "u1")
    kind = next((k for k in range(len(ENCODINGS)) if (PLACE[k, raw] >= 0).all()), None)
    if kind is None or _readable(token, kind):
        return None
    return kind, int(np.searchsorted(LENGTHS, len(token), "right")) - 1, battery(PLACE[kind, raw][None], len(ENCODINGS[kind]))[0]


def _words(triples: np.ndarray, rng: np.random.Generator, n: int, length: int) -> list[list[str]]:
    """n runs of words by the chain of letter triples, of ``length`` letters and gaps each."""
    three = triples.reshape(27, 27, 27).astype("f8")
    two, one = three.sum(axis=0), three.sum(axis=(0, 1)) + 1e-3
    two = (two + 0.1 * one / one.sum()) / (two.sum(axis=1, keepdims=True) + 0.1)  # what was not seen goes by pairs, then letters
    chance = np.cumsum(three + 0.1 * two[None], axis=2)
    chance /= chance[:, :, -1:]
    a, b, out = np.zeros(n, "i8"), np.zeros(n, "i8"), np.zeros((n, length), "u1")
    for k in range(length):
        c = np.minimum((chance[a, b] < rng.random(n)[:, None]).sum(axis=1), 26)
        out[:, k], a, b = c, b, c
    text = np.where(out == 0, 32, out + 96).astype("u1")
    return [[w for w in bytes(row).decode().split() if len(w) > 1] or ["a"] for row in text]


def ordinary(triples: np.ndarray, seed: int = 11) -> dict[str, list[str]]:
    """Names, paths and numbers of ordinary kinds, longer than the last of LENGTHS."""
    rng, longest = np.random.default_rng(seed), int(LENGTHS[-1])
    texts, out = _words(triples, rng, SIMULATED, 2 * longest + 40), {}
    numbered = [[x for w in words for x in ([w, str(rng.integers(0, 10 ** rng.integers(1, 5)))] if rng.random() < 0.3 else [w])] for words in texts]
    for name, source in (("plain", texts), ("numbered", numbered)):
        for joint in ("", "_", "-", "/"):
            out[name + joint] = [joint.join(w) for w in source]
        out[name + "Camel"] = ["".join(w.capitalize() for w in words) for words in source]
        out[name + "UPPER"] = ["".join(words).upper() for words in source]
    # Decimal numbers with a letter or a few, as of versions, sizes and dates.
    digits = rng.integers(48, 58, (SIMULATED, longest)).astype("u1")
    for row in digits:
        at = rng.integers(0, 12, rng.integers(1, 4))
        row[at] = rng.integers(97, 103, len(at))
    out["number"] = [bytes(row).decode() for row in digits]
    out["NUMBER"] = [x.upper() for x in out["number"]]
    return out


class Null:
    """What ordinary and random tokens are like, by encoding and length, from simulated ones."""

    def __init__(self, triples: np.ndarray):
        rng = np.random.default_rng(5)
        shape = (len(ENCODINGS), len(LENGTHS))
        self.random: dict[tuple[int, int], tuple] = {}
        self.kinds: dict[tuple[int, int], list[tuple]] = {}
        self.chance, self.edges = np.zeros((*shape, CLASSES)), LOWEST + (np.arange(CLASSES) + 1) * STEP
        own: dict[tuple[int, int], list[np.ndarray]] = {}
        for raw in self._simulated(triples, rng):
            fits = np.array([np.minimum.accumulate(PLACE[k, raw] >= 0, axis=1) for k in range(len(ENCODINGS))])
            for j, n in enumerate(LENGTHS.tolist()):
                tail = rng.choice([0, 0, 1, 2, 3, 4, 6, 8], len(raw))  # half of the names end in a number
                cut = np.where(np.arange(n) < n - tail[:, None], raw[:, :n], rng.integers(48, 58, (len(raw), n))).astype("u1")
                ok = fits[:, :, n - 1]
                first = np.where(ok.any(axis=0), ok.argmax(axis=0), -1)
                for k in np.unique(first[first >= 0]).tolist():
                    for tailed in (False, True):
                        some, at = cut[(first == k) & ((tail > 0) == tailed)], 4 if tailed and k == 2 else k  # base32 lacks most digits
                        if len(some) >= SIMULATED // 20:
                            own.setdefault((at, j), []).append(battery(PLACE[at, some], len(ENCODINGS[at])))
        for k, alphabet in enumerate(ENCODINGS):
            for j, n in enumerate(LENGTHS.tolist()):
                even = battery(rng.integers(0, len(alphabet), (SIMULATED, n)), len(alphabet))
                self.random[k, j] = self._shape(even)
                # Where ordinary tokens never fall into an encoding, those of the next shorter length stand for them.
                found = own.get((k, j))
                self.kinds[k, j] = [self._shape(z) for z in found] if found else self.kinds.get((k, j - 1), [])
                if not found:
                    self.chance[k, j] = self.chance[k, j - 1] if j else 1.0
                for z in found or []:
                    s = np.sort(self.score(k, j, z))
                    at = max(10, int(TAIL * len(s)))
                    mean = max(0.05, float((s[at] - s[:at]).mean()))  # beyond TAIL the chance falls off exponentially
                    p = np.where(self.edges < s[at], (at + 1) / len(s) * np.exp(np.minimum(0, self.edges - s[at]) / mean), np.searchsorted(s, self.edges, "right") / len(s))
                    self.chance[k, j] = np.maximum(self.chance[k, j], p)
        self.chance = np.maximum(np.minimum(self.chance, 1.0), 1e-12)

    @staticmethod
    def _simulated(triples: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
        for tokens in ordinary(triples).values():
            tokens = [t for t in tokens if len(t) >= LENGTHS[-1]]
            yield np.frombuffer("".join(t[: LENGTHS[-1]] for t in tokens).encode(), "u1").reshape(len(tokens), -1)

    @staticmethod
    def _shape(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        cov = np.cov(z.T) + 1e-3 * np.eye(3)
        return z.mean(axis=0), np.linalg.inv(cov), float(np.log(np.linalg.det(cov)))

    @staticmethod
    def _far(z: np.ndarray, shape: tuple) -> np.ndarray:
        d = z - shape[0]
        return np.einsum("ij,jk,ik->i", d, shape[1], d)

    def score(self, k: int, j: int, z: np.ndarray) -> np.ndarray:
        """Log likelihood of the best kind of ordinary tokens less that of random ones; HIGHEST where no random token is so."""
        away = self._far(z, self.random[k, j])
        best = np.max([-0.5 * (self._far(z, x) + x[2]) for x in self.kinds[k, j]], axis=0) if self.kinds[k, j] else np.full(len(z), HIGHEST)
        return np.where(away > -2 * math.log(VETO) + 4, HIGHEST, np.minimum(HIGHEST, best + 0.5 * (away + self.random[k, j][2])))

    def classes(self, k: int, j: int, z: np.ndarray) -> np.ndarray:
        return np.clip((self.score(k, j, z) - LOWEST) / STEP, 0, CLASSES - 1).astype("i8")


class Rule:
    """Which tokens are finds: those in a class below the cut of their encoding and length."""

    def __init__(self, null: Null, seen: dict[tuple[int, int, int], int], rate: float = RATE):
        """seen: how many tokens of all documents are in each (encoding, length, class)."""
        self.null, total = null, sum(seen.values())
        self.cut = np.zeros((len(ENCODINGS), len(LENGTHS)), "i8")
        if total:
            mean = sum(n * LENGTHS[j] for (_, j, _), n in seen.items()) / total
            weighed = null.chance * (mean / LENGTHS)[None, :, None]
            found, limit = 0, -1.0
            for q, n in sorted((weighed[cell], n) for cell, n in seen.items()):
                found += n
                if q <= rate * found / total:
                    limit = q
            self.cut = np.minimum((weighed <= limit).sum(axis=2), CLASSES - 1)  # p-values grow with the class

    def holds(self, token: str) -> bool:
        cell = examine(token)
        return cell is not None and bool(self.null.classes(*cell[:2], cell[2][None])[0] < self.cut[cell[:2]])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' spans."""
    spans: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    longest = max(map(len, text.split()), default=0)
    if longest >= 16 and "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if longest >= 32:
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return spans


def long_tokens(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the long tokens of what the patterns leave."""
    if max(map(len, text.split()), default=0) < SHORTEST:
        return []
    edges = sorted((a, b) for a, _, b in base)
    out, at = [], 0
    for a, b in [*edges, (len(text), len(text))]:
        if a > at:
            out += [m.span() for m in LONG.finditer(text, at, a)]
        at = max(at, b)
    return out


def find(text: str | None, rule: Rule) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every span in code points, by start, then kind as in KINDS; null is an empty text."""
    if not text:
        return []
    spans = base_spans(text)
    for a, b in long_tokens(text, spans.copy()):
        if rule.holds(text[a:b]):
            spans.append((a, 3, b))
    return [(a, KINDS[k], b) for a, k, b in sorted(spans)]


def fit(docs: DataFrame, rate: float = RATE) -> Rule:
    """The rule for all texts of docs; what reaches the driver is bounded by the triples and the classes of scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triples = np.zeros(27**3, "i8")
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                c = FOLD[np.frombuffer(f" {text} ".encode("latin-1", "replace"), "u1")]
                triples += np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=27**3)
                found += [(k, j, 1, *z.tolist()) for a, b in long_tokens(text, base_spans(text)) if (cell := examine(text[a:b])) for k, j, z in [cell]]
            if found:
                yield _rows(found)
        some = np.flatnonzero(triples).tolist()
        yield _rows([(-1, k, int(triples[k]), 0.0, 0.0, 0.0) for k in some])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), pa.int64()] + [pa.float64()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], ["kind", "length", "n", "z1", "z2", "z3"])

    told = stash(docs.select(F.col("text").cast("string")).mapInArrow(run, "kind int, length int, n long, z1 double, z2 double, z3 double"), "battery")
    triples = np.zeros(27**3, "i8")
    for k, n in told.where("kind < 0").groupBy("length").agg(F.sum("n")).collect():
        triples[k] = n
    null = Null(triples)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, length = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            z, level = np.stack([batch.column(c).to_numpy() for c in (2, 3, 4)], axis=1), np.zeros(len(kind), "i8")
            for k, j in set(zip(kind.tolist(), length.tolist())):
                own = (kind == k) & (length == j)
                level[own] = null.classes(k, j, z[own])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(level)], ["kind", "length", "level"])

    scored = told.where("kind >= 0").select("kind", "length", "z1", "z2", "z3").mapInArrow(classed, "kind int, length int, level long")
    seen = {(r[0], r[1], r[2]): r[3] for r in scored.groupBy("kind", "length", "level").count().collect()}
    return Rule(null, seen, rate)


SPANS = "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """docs with n_assign, n_access, n_hex, n_random, base_sha256 and spans; such columns of docs are replaced.

    A span is kind:start:end in code points, end exclusive, spans joined by
    commas; base_sha256 is of the spans of the first three kinds. A null or
    empty text has no spans. Rows are scanned one by one, whole; the cuts for
    random tokens come from all of them (repeated rows count as often as they
    occur), so no rows have none.
    """
    rule = fit(docs, rate)

    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            found = find(text, rule)
            said = [(k, f"{k}:{a}:{b}") for a, k, b in found]
            n = Counter(k for k, _ in said)
            base = hashlib.sha256(",".join(s for k, s in said if k != "random").encode()).hexdigest()
            rows.append((n["assign"], n["access"], n["hex"], n["random"], base, ",".join(s for _, s in said)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        columns = zip(*rows) if rows else [[]] * 6
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in SPANS.split(", ")])

    names = [c.split()[0] for c in SPANS.split(", ")]
    keep = [c for c in docs.columns if c not in names]
    found = docs.select(carried(docs, keep), run(F.col("text").cast("string")).alias("found"))
    return found.select("own.*", *[F.col(f"found.{c}").alias(c) for c in names])


def redact(text: str | None, rule: Rule, mark: str = "[SECRET]") -> str | None:
    """text with each run of overlapping spans replaced by mark; null stays null. Redacted text has nothing left to find by the same rule."""
    out, at = [], 0
    for a, _, b in find(text, rule):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return text if not out else "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", rate: float = RATE) -> DataFrame:
    """docs with secrets in text replaced by mark and n_chars (where there is one) made to fit. Every row stays.

    Null and empty texts stay as they are; no rows give no rows.
    """
    rule = fit(docs, rate)

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([redact(x, rule, mark) for x in texts.to_pylist()], pa.string())

    out = docs.withColumn("text", run(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
