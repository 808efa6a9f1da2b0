"""Language identification by cross-parsing entropy.

A suffix automaton is built over labelled text of every language: whole texts of a bounded sample of rows. A
document is parsed greedily against each automaton: a phrase is the longest match that starts where the
last one ended, and the next phrase starts at the mismatch. A letter that the language's text lacks
counts as one more phrase. The phrases are normalised to bits: each names a place in the language's
text, log2 of its length, and a length of its own, 2 log2 of the mean phrase + 1. The language with
the fewest bits wins. Whole texts are parsed; long ones in segments of SEGMENT symbols side by side,
which costs at most one extra phrase a segment for every language alike.

Alphabets have no limit: transitions lie in one sparse array a language, found by displacement.

Defined results: null or letterless text gives ``und`` with score 0; ties go to the language that
sorts first; repeated rows each get a row; an empty table gives no rows; no learnable row at all
makes every prediction ``und``; a single language scores against spelling letters one by one;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aspectdrift.llm.common import KEYS, hash_key

UNKNOWN = "und"
SEGMENT = 512
BLOCK_CHARS = 2 << 20


@dataclass
class Table:
    """Transitions of one automaton: slot base[state] + symbol holds `to` if it is owned by the state.

    anew[symbol] is the state after starting anew with a symbol, 0 for one that the text lacks.
    """

    base: np.ndarray
    owner: np.ndarray
    to: np.ndarray
    anew: np.ndarray
    length: int


@dataclass
class Parser:
    """What executors need: letters by code point, shared by all languages, and one table a language."""

    langs: list[str]
    symbols: dict[int, int]
    tables: list[Table]

    @property
    def width(self) -> int:
        return len(self.symbols) + 2

    def codes(self) -> np.ndarray:
        """Symbol of every code point: 0 no letter, width - 1 a letter that no training text has."""
        out = np.where(_letters(), self.width - 1, 0).astype(np.int32)
        out[list(self.symbols)] = list(self.symbols.values())
        return out


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a symbol sequence; state 0 is the root."""
    out: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(out)
        out.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in out[p]:
            out[p][c] = new
            p = link[p]
        if p >= 0:
            q = out[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(out)
                out.append(dict(out[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and out[p].get(c) == q:
                    out[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return out


def table_of(steps: list[dict[int, int]], width: int, length: int, seed: int = 1) -> Table:
    """Place every state's transitions at a drawn base where they all find free slots, states of many first."""
    degree = np.array([len(by) for by in steps])
    first = np.concatenate(([0], np.cumsum(degree)))
    symbol = np.fromiter((c for by in steps for c in by), np.int64, first[-1])
    target = np.fromiter((t for by in steps for t in by.values()), np.int32, first[-1])
    size = 1 << int(max(4 * first[-1], 2 * width, 2) - 1).bit_length()
    base, owner, to = np.zeros(len(steps), np.int32), np.full(size, -1, np.int32), np.zeros(size, np.int32)
    rng, claim = np.random.default_rng(seed), np.full(size, -1, np.int64)
    rank = np.frexp(degree)[1]
    for r in range(int(rank.max(initial=0)), 0, -1):
        left = np.flatnonzero(rank == r)
        while len(left):
            n = degree[left]
            drawn = rng.integers(0, size, len(left))
            own = np.repeat(np.arange(len(left)), n)
            each = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + first[left][own]
            slot = (drawn[own] + symbol[each]) & (size - 1)
            claim[slot] = own
            bad = np.bincount(own, (claim[slot] != own) | (owner[slot] >= 0), minlength=len(left)) > 0
            fits = ~bad[own]
            owner[slot[fits]], to[slot[fits]] = left[own[fits]], target[each[fits]]
            base[left[~bad]] = drawn[~bad]
            left = left[bad]
    anew = np.zeros(width, np.int32)
    anew[list(steps[0])] = list(steps[0].values())
    return Table(base, owner, to, anew, length)


def normalised(text: str, codes: np.ndarray) -> np.ndarray:
    """Symbols of a lower-cased text, each run of other characters as one 0."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = codes[points]
    if len(s):
        keep = s != 0
        keep[1:] |= keep[:-1]
        s = s[keep]
    return s


def learned(sample: dict[str, list[str]]) -> Parser:
    """A parser from texts by language."""
    letters = sorted({ord(c) for texts in sample.values() for t in texts for c in set(t.lower()) if c.isalpha()})
    parser = Parser(sorted(sample), {c: i + 1 for i, c in enumerate(letters)}, [])
    codes = parser.codes()
    for lang in parser.langs:
        s = normalised(" ".join(sample[lang]), codes)
        parser.tables.append(table_of(automaton(s.tolist()), parser.width, len(s)))
    return parser


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = 64, most_chars: int = 100_000,
) -> Parser:
    """Learn from a bounded sample of labelled rows, whole texts only.

    Of each language the rows with the smallest id hash, rows_per_lang at most and as long as their
    texts together have most_chars at most; the first row counts in any case. Rows longer than that
    by themselves come last, by length. Rows without language or letter don't count.
    """
    lang, text = F.col(lang_col).cast("string"), F.col(text_col).cast("string")
    key = hash_key(F.col(id_col).cast("string"), "lang-id")
    rows = docs.where(lang.isNotNull() & text.rlike(r"\p{L}")).select(lang.alias("lang"), key.alias("k"), text.alias("text"))
    # The smallest keys of a language lie under a bound that its size gives, so few rows are ever ranked. One row a language.
    sizes = rows.groupBy("lang").count().collect()
    if not sizes:
        return learned({})
    bound = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(KEYS, 1 + 4 * rows_per_lang * KEYS // r["count"]))])
    n = F.length("text")
    order = Window.partitionBy("lang").orderBy(F.when(n > most_chars, n).otherwise(0), "k", "text")
    near = rows.where(F.col("k") < F.element_at(bound, F.col("lang"))).withColumn("r", F.row_number().over(order))
    near = near.where(F.col("r") <= rows_per_lang).withColumn("sum", F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text_of: dict[str, list[str]] = {}
    for row in sorted(near.where((F.col("sum") <= most_chars) | (F.col("r") == 1)).select("lang", "r", "text").collect()):
        text_of.setdefault(row.lang, []).append(row.text)
    return learned(text_of)


def phrases(parts: list[np.ndarray], table: Table) -> np.ndarray:
    """Phrases that each symbol array needs, all segments in lock step: a few gathers a step for all of them."""
    owner, lane, place = [], [], []
    for i, s in enumerate(parts):
        for at in range(0, len(s), SEGMENT):
            owner.append(i)
            lane.append(min(SEGMENT, len(s) - at))
            place.append(s[at : at + SEGMENT])
    total = np.zeros(len(parts), np.int64)
    if not lane:
        return total
    order = np.argsort(-np.array(lane), kind="stable")
    size = np.array(lane)[order]
    grid = np.zeros((size[0], len(size)), np.int32)
    for j, k in enumerate(order):
        grid[: size[j], j] = place[k]
    active = np.searchsorted(-size, -np.arange(size[0]), side="left")
    state, misses, mask = np.zeros(len(size), np.int32), np.ones(len(size), np.int64), np.int32(len(table.owner) - 1)
    for k, m in enumerate(active):
        now, c = state[:m], grid[k, :m]
        slot = (table.base[now] + c) & mask
        met = table.owner[slot] == now
        misses[:m] += ~met
        state[:m] = np.where(met, table.to[slot], table.anew[c])
    np.add.at(total, np.array(owner)[order], misses)
    return total


def bits(parts: list[np.ndarray], table: Table) -> np.ndarray:
    """What each symbol array costs by one language's text."""
    n = np.array([len(s) for s in parts])
    lacking = np.array([np.count_nonzero((table.anew[s] == 0) & (s > 0)) for s in parts])
    c = np.maximum(phrases(parts, table) + lacking, 1)
    return c * (np.log2(table.length + 2) + 2 * np.log2(np.maximum(n / c, 1)) + 1)


def classify(texts: list[str | None], parser: Parser, codes: np.ndarray) -> list[tuple[str, float]]:
    out: list[tuple[str, float]] = []
    held: list[np.ndarray] = []

    def flush() -> None:
        if not held:
            return
        cost = np.stack([bits(held, t) for t in parser.tables]) if parser.tables else np.empty((0, len(held)))
        for i, s in enumerate(held):
            if not len(cost) or not s.any():
                out.append((UNKNOWN, 0.0))
                continue
            by = np.argsort(cost[:, i], kind="stable")
            best = cost[by[0], i]
            second = cost[by[1], i] if len(by) > 1 else len(s) * (np.log2(parser.width) + 1)
            out.append((parser.langs[by[0]], float(max(0.0, 1 - best / second))))
        held.clear()

    size = 0
    for text in texts:
        held.append(normalised(text or "", codes))
        size += len(held[-1])
        if size >= BLOCK_CHARS:
            flush()
            size = 0
    flush()
    return out


def identify(docs: DataFrame, parser: Parser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, lang_pred, score from 0 (no lead over the next language) to 1."""
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        codes = parser.codes()
        for batch in batches:
            got = classify(batch.column(1).to_pylist(), parser, codes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=[id_col, "lang_pred", "score"],
            )

    return source.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def is_held_out(id_col: str = "doc_id"):
    """Documents whose crc32 of the id as text leaves 2 modulo 4; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op1(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of all documents, learned from those not held out (a null id is not learned from)."""
    learn = docs.where(F.col("doc_id").isNotNull() & ~is_held_out())
    parser = fit(learn)
    return identify(docs, parser).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
