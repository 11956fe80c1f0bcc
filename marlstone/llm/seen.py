"""Has this key been seen before? Sharded quotient filters that answer in the order of arrival, and are kept between runs.

A key's hash is split into a quotient, the home slot, and a remainder, which alone is stored, with three bits of run
metadata for each slot. A run loads each shard's saved filter, asks it, merges what came in and gives the filter to be
saved again; no earlier key is read. Wrong answers can only be false sightings: their rate is derived from the bits that
are stored and can be measured.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a stored remainder at the size that a layout is meant for: a false sighting has a chance of about
#: load / 2^32 for each question.
REMAINDER_BYTES = 4
#: Filled share of a filter's home slots, at most.
LOAD = 0.75
#: Questions that a shard answers before what they brought is merged into its filter.
BLOCK = 1 << 16
#: Keys that one shard is meant to hold.
SHARD_ROWS = 400_000
#: Bits of the hash that fingerprints come from; shards come from another hash, so all of these are theirs.
HASH_BITS = 64


@dataclass(frozen=True)
class QuotientFilter:
    """Sorted distinct fingerprints of `bits` bits as slots of remainders (of bits - q bits) with run metadata.

    occupied: a run exists for this quotient; continuation: the slot goes on with the run of the slot before;
    filled: the slot holds a remainder. Slots reach beyond 2^q where the last runs are pushed past the end.
    """

    bits: int
    q: int
    occupied: np.ndarray
    continuation: np.ndarray
    filled: np.ndarray
    remainders: np.ndarray  # uint8, by slot and byte
    n: int

    @staticmethod
    def quotient_bits(n: float, load: float = LOAD) -> int:
        return max(4, int(np.ceil(np.log2(max(1, n) / load))))

    @classmethod
    def build(cls, fingerprints: np.ndarray, bits: int, q: int | None = None) -> QuotientFilter:
        """From sorted distinct fingerprints (uint64); q fits their number where none is given."""
        n = len(fingerprints)
        q = min(cls.quotient_bits(n) if q is None else q, bits - 1)
        r = np.uint64(bits - q)
        quotients = (fingerprints >> r).astype(np.int64)
        # A run starts at its home slot or behind the run before it.
        order = np.arange(n, dtype=np.int64)
        slots = order + np.maximum.accumulate(quotients - order) if n else order
        size = max(1 << q, int(slots[-1]) + 1 if n else 0)
        occupied, continuation, filled = (np.zeros(size, bool) for _ in range(3))
        occupied[quotients] = True
        filled[slots] = True
        continuation[slots[1:]] = quotients[1:] == quotients[:-1]
        width = -(-(bits - q) // 8)
        remainders = np.zeros((size, width), np.uint8)
        kept = fingerprints & ((np.uint64(1) << r) - np.uint64(1)) if bits - q < 64 else fingerprints
        remainders[slots] = kept.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]
        return cls(bits, q, np.packbits(occupied), np.packbits(continuation), np.packbits(filled), remainders, n)

    def _bits(self, packed: np.ndarray) -> np.ndarray:
        return np.unpackbits(packed, count=len(self.remainders)).astype(bool)

    def _stored(self, slots: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(slots), 8), np.uint8)
        wide[:, 8 - self.remainders.shape[1] :] = self.remainders[slots]
        return wide.view(">u8")[:, 0].astype(np.uint64)

    def fingerprints(self) -> np.ndarray:
        """The sorted fingerprints again: the i-th run belongs to the i-th occupied quotient."""
        if not self.n:
            return np.empty(0, np.uint64)
        slots = np.flatnonzero(self._bits(self.filled))
        run = np.cumsum(~self._bits(self.continuation)[slots]) - 1
        homes = np.flatnonzero(self._bits(self.occupied)).astype(np.uint64)
        return (homes[run] << np.uint64(self.bits - self.q)) | self._stored(slots)

    def contains(self, fingerprints: np.ndarray) -> np.ndarray:
        found = np.zeros(len(fingerprints), bool)
        if not self.n or not len(fingerprints):
            return found
        r = np.uint64(self.bits - self.q)
        occupied, filled = self._bits(self.occupied), self._bits(self.filled)
        slots = np.flatnonzero(filled)
        starts = np.append(np.flatnonzero(~self._bits(self.continuation)[slots]), len(slots))
        quotients = (fingerprints >> r).astype(np.int64)
        asked = np.flatnonzero(occupied[quotients])
        run = np.cumsum(occupied)[quotients[asked]] - 1
        at, end = starts[run], starts[run + 1]
        wanted = fingerprints[asked] & ((np.uint64(1) << r) - np.uint64(1))
        while len(asked):  # as often as the longest run has slots
            hit = self._stored(slots[at]) == wanted
            found[asked[hit]] = True
            on = ~hit & (at + 1 < end)
            asked, at, end, wanted = asked[on], at[on] + 1, end[on], wanted[on]
        return found

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        """Both filters' fingerprints, which must have the same length, in one filter that fits them.

        As a filter grows, bits move from the remainder to the quotient; the fingerprint stays as it is, so no key is
        needed and the chance of a false sighting stays what the fingerprint's length makes it.
        """
        if self.bits != other.bits:
            raise ValueError("fingerprints of different length")
        both = np.concatenate([self.fingerprints(), other.fingerprints()])
        both.sort(kind="stable")  # two sorted stretches
        return QuotientFilter.build(both[np.append(True, both[1:] != both[:-1])] if len(both) else both, self.bits)

    @property
    def stored_bytes(self) -> int:
        return self.remainders.nbytes + self.occupied.nbytes * 3


def false_rate(n: int, bits: int) -> float:
    """The derived chance that a new key meets one of n fingerprints of its shard: 1 - (1 - 2^-bits)^n."""
    return float(-np.expm1(n * np.log1p(-(2.0**-bits))))


@dataclass(frozen=True)
class Layout:
    """What saved filters have in common: how many shards, and the bits of a fingerprint within its shard."""

    n_shards: int
    bits: int

    @classmethod
    def of(cls, keys: int, width: int = REMAINDER_BYTES, shard_rows: int = SHARD_ROWS) -> Layout:
        """For so many keys in the end: quotients that fit a shard of them, and remainders of `width` bytes."""
        n_shards = max(1, 1 << int(np.ceil(np.log2(max(1, keys / shard_rows)))))
        bits = QuotientFilter.quotient_bits(keys / n_shards) + 8 * width
        if bits >= HASH_BITS:
            raise ValueError("a shard of so many keys needs more bits than the hash has")
        return cls(n_shards, bits)

    def hashed(self, df: DataFrame, key: Column, *others: Column) -> DataFrame:
        """others, fp and shard of the rows whose key isn't null; fingerprint and shard come from different hashes."""
        rows = df.select(*others, key.alias("_key")).filter(F.col("_key").isNotNull())
        kept = [c for c in rows.columns if c != "_key"]
        return rows.select(*kept, F.shiftrightunsigned(F.xxhash64("_key"), HASH_BITS - self.bits).alias("fp"), F.pmod(F.hash("_key"), F.lit(self.n_shards)).cast("int").alias("shard"))


_STATE = "q int, n bigint, occupied binary, continuation binary, filled binary, remainders binary"
FILTERS = f"shard int, {_STATE}"
ASKED = f"seq bigint, seen boolean, {FILTERS}, n_before bigint"
_STATE_TYPES = {"q": pa.int32(), "n": pa.int64(), "occupied": pa.binary(), "continuation": pa.binary(), "filled": pa.binary(), "remainders": pa.binary()}


def _saved(f: QuotientFilter) -> dict:
    arrays = {a: getattr(f, a).tobytes() for a in ("occupied", "continuation", "filled", "remainders")}
    return {"q": f.q, "n": f.n} | arrays


def _loaded(row: dict, bits: int) -> QuotientFilter:
    width = -(-(bits - row["q"]) // 8)
    flags = (np.frombuffer(row[a], np.uint8) for a in ("occupied", "continuation", "filled"))
    return QuotientFilter(bits, row["q"], *flags, np.frombuffer(row["remainders"], np.uint8).reshape(-1, width), row["n"])


def build_filters(known: DataFrame, key: Column, layout: Layout) -> DataFrame:
    """One row of FILTERS for each shard that holds a key of `known`; null keys are left out."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, shard = (batch.column(n).to_numpy() for n in ("fp", "shard"))
            pairs = np.unique(np.rec.fromarrays([shard, fp], names="shard,fp"))  # a hot key: one row a batch
            yield pa.record_batch([pa.array(pairs["fp"]), pa.array(pairs["shard"])], names=["fp", "shard"])

    def build(group: pa.Table) -> pa.Table:
        made = QuotientFilter.build(np.unique(group.column("fp").to_numpy().view(np.uint64)), layout.bits)
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32())} | {k: pa.array([v], _STATE_TYPES[k]) for k, v in _saved(made).items()})

    return layout.hashed(known, key).mapInArrow(once, "fp bigint, shard int").groupBy("shard").applyInArrow(build, FILTERS)


def save_filters(filters: DataFrame, path: str) -> DataFrame:
    """Writes filters to a folder that all executors share, and gives them as they are read from there."""
    filters.write.mode("errorifexists").parquet(path)
    return filters.sparkSession.read.schema(FILTERS).parquet(path)


def _local(layout: Layout):
    """Settle inside a batch what it can settle: of equal fingerprints only the earliest record needs to be asked about.

    So a key with a third of all rows brings its shard no more than one open question for each batch. What is settled
    goes to any shard, by its seq.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            seq, fp, shard = (batch.column(n).to_numpy() for n in ("seq", "fp", "shard"))
            order = np.lexsort((seq, fp, shard))
            seq, fp, shard = seq[order], fp[order], shard[order]
            same = (fp[1:] == fp[:-1]) & (shard[1:] == shard[:-1])
            keep = np.append(True, (seq[1:] != seq[:-1]) | ~same)  # a repeat of a record is the same record
            seq, fp, shard = seq[keep], fp[keep], shard[keep]
            settled = np.append(False, (fp[1:] == fp[:-1]) & (shard[1:] == shard[:-1]))
            at = np.where(settled, seq.view(np.uint64) % np.uint64(layout.n_shards), shard).astype(np.int32)
            yield pa.record_batch([pa.array(seq), pa.array(fp), pa.array(settled), pa.array(at)], names=["seq", "fp", "settled", "shard"])

    return run


def answered(seq: np.ndarray, fp: np.ndarray, held: list[QuotientFilter], bits: int) -> np.ndarray:
    """For each record in order of arrival whether its fingerprint is in a filter or came with a lower seq.

    Records go in blocks; what they bring is merged into `held`, which stays a short list of filters of falling size.
    """
    seen = np.zeros(len(seq), bool)
    for at in range(0, len(seq), BLOCK):
        block = fp[at : at + BLOCK]
        known = np.zeros(len(block), bool)
        for f in held:
            known |= f.contains(block)
        unique, where = np.unique(block, return_index=True)  # where: its earliest place
        later = np.ones(len(block), bool)
        later[where] = False
        seen[at : at + BLOCK] = known | later
        held.append(QuotientFilter.build(unique, bits))
        while len(held) > 1 and held[-2].n < 2 * held[-1].n:
            held[-2:] = [held[-2].merge(held[-1])]
    return seen


def _answerer(layout: Layout, keep: bool) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The shard's task: loads its filter, answers, and gives the merged filter as a row behind the answers."""

    def answer(key: tuple, group: pa.Table, saved: pa.Table) -> pa.Table:
        settled = group.column("settled").to_numpy().astype(bool)
        seq, fp = group.column("seq").to_numpy(), group.column("fp").to_numpy().view(np.uint64)
        easy = np.unique(seq[settled])
        seq, fp = seq[~settled], fp[~settled]
        order = np.lexsort((fp, seq))
        seq, fp = seq[order], fp[order]
        if len(seq):
            once = np.append(True, (seq[1:] != seq[:-1]) | (fp[1:] != fp[:-1]))
            seq, fp = seq[once], fp[once]
        held = [_loaded(row, layout.bits) for row in saved.to_pylist()]
        before = sum(f.n for f in held)
        seen = answered(seq, fp, held, layout.bits)
        out_seq, out_seen = np.concatenate([easy, seq]), np.concatenate([np.ones(len(easy), bool), seen])
        state = _saved(reduce(QuotientFilter.merge, held)) if keep and held else None
        rows = len(out_seq) + bool(state)
        last = lambda v, t: pa.array([None] * len(out_seq) + ([v] if state else []), t)
        columns = {
            "seq": pa.array(np.append(out_seq, [0] * bool(state)), pa.int64(), mask=np.arange(rows) >= len(out_seq)),
            "seen": pa.array(np.append(out_seen, [False] * bool(state)), pa.bool_(), mask=np.arange(rows) >= len(out_seq)),
            "shard": pa.array(np.full(rows, key[0].as_py()), pa.int32()),
        }
        return pa.table(columns | {n: last(state and state[n], t) for n, t in _STATE_TYPES.items()} | {"n_before": last(before, pa.int64())})

    return answer


def ask(filters: DataFrame, records: DataFrame, key: Column, seq: Column, layout: Layout, keep: bool = True) -> DataFrame:
    """Rows of ASKED: the answers (seq, seen), and with `keep` one row for each shard with its filter afterwards.

    Write it down once (cut_lineage) where both kinds are read; see answers and filters_after.

    * A null key is never seen and never an earlier sighting; a record without seq has no place in the order. Both
      kinds get no answer, that is, no row.
    * Records of this run come after those of earlier runs, which the filters hold.
    * An empty table gives no answers; other columns play no part.
    """
    hashed = layout.hashed(records, key, seq.cast("bigint").alias("seq")).filter(F.col("seq").isNotNull())
    local = hashed.mapInArrow(_local(layout), "seq bigint, fp bigint, settled boolean, shard int")
    return local.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_answerer(layout, keep), ASKED)


def answers(asked: DataFrame) -> DataFrame:
    """seq, seen, each seq once: rows with the same seq and key are the same record. Should one seq come with several keys,
    it is seen if any of them is.
    """
    return asked.filter(F.col("seq").isNotNull()).groupBy("seq").agg(F.max("seen").alias("seen"))


def seen_seqs(asked: DataFrame) -> DataFrame:
    """seq of the records that were seen, each once; only those are brought together."""
    return asked.filter("seen").select("seq").distinct()


def filters_after(asked: DataFrame) -> DataFrame:
    """The filters to be saved for the next run."""
    return asked.filter(F.col("q").isNotNull()).select("shard", *_STATE_TYPES)


def seen_before(
    records: DataFrame, key: Column, seq: Column, known: DataFrame | None = None, known_key: Column | None = None,
    width: int = REMAINDER_BYTES, shard_rows: int = SHARD_ROWS, rows: int | None = None, path: str | None = None, keep: bool = False,
) -> tuple[DataFrame, Layout]:
    """The first run over `records`, as ask gives it, and its layout: `known` goes into filters, saved under `path` if given.

    rows: how many keys the filters are to hold in the end; without it the rows of both tables are counted.
    """
    rows = records.count() + (known.count() if known is not None else 0) if rows is None else rows
    layout = Layout.of(rows, width, shard_rows)
    filters = records.sparkSession.createDataFrame([], FILTERS) if known is None else build_filters(known, known_key, layout)
    return ask(save_filters(filters, path) if path else filters, records, key, seq, layout, keep), layout


def derived_wrong(asked: DataFrame, layout: Layout) -> DataFrame:
    """derived: how many false sightings to expect. A shard's i-th key meets those before it, in 2^bits places."""
    pairs = lambda n: F.col(n).cast("double") * (F.col(n) - 1) / 2
    shards = asked.filter(F.col("q").isNotNull())
    return shards.agg(F.coalesce(F.sum(pairs("n") - pairs("n_before")) / 2.0**layout.bits, F.lit(0.0)).alias("derived"))


def measured_wrong(answered: DataFrame, records: DataFrame, key: Column, seq: Column, known: DataFrame, known_key: Column) -> DataFrame:
    """n_answers, n_seen, n_wrong: every answer held against the full keys, by an exact first sighting of each key."""
    asked = records.select(seq.alias("seq"), key.alias("_key")).filter(F.col("seq").isNotNull() & F.col("_key").isNotNull())
    earlier = known.select(F.lit(None).cast("bigint").alias("seq"), known_key.alias("_key")).filter(F.col("_key").isNotNull())
    first = asked.unionByName(earlier).groupBy("_key").agg(F.min("seq").alias("seq"), F.max(F.col("seq").isNull()).alias("_known"))
    fresh = first.filter(~F.col("_known")).select("seq", F.lit(True).alias("_fresh"))  # the only answers that should be no
    held = answered.join(fresh, "seq", "left").withColumn("_truly", F.coalesce(~F.col("_fresh"), F.lit(True)))
    return held.agg(
        F.count(F.lit(1)).alias("n_answers"),
        F.count_if("seen").alias("n_seen"),
        F.count_if(F.col("seen") != F.col("_truly")).alias("n_wrong"),
    )
