"""Simulated sequences and reads, in column expressions: every draw is a hash of the row's key, so a rerun of a lost
task draws the same and results don't depend on partitions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import PairModel


@dataclass(frozen=True)
class Profile:
    """Rates of substitutions, deletions and insertions."""

    sub: float = 0.01
    deletion: float = 0.01
    ins: float = 0.01

    def scaled(self, factor: float) -> Profile:
        return Profile(self.sub * factor, self.deletion * factor, self.ins * factor)

    @property
    def total(self) -> float:
        return self.sub + self.deletion + self.ins

    def normalised(self) -> Profile:
        return self.scaled(1 / self.total)


CCS = Profile(0.002, 0.004, 0.004)


def _draw(*key: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _base(u: Column) -> Column:
    return F.substring(F.lit("ACGT"), F.floor(u * 4).cast("int") + 1, F.lit(1))


def random_sequence(length: Column, *key: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), length.cast("int")), lambda i: _base(_draw(*key, i, F.lit(11)))), "")


def noisy(seq: Column, profile: Profile, *key: Column) -> Column:
    """Independent errors at each base: a substitution by another base, a deletion, or a base inserted before it."""
    sub, gone, ins = profile.sub, profile.sub + profile.deletion, profile.total

    def step(i: Column) -> Column:
        u, own = _draw(*key, i, F.lit(1)), F.substring(seq, i, F.lit(1))
        other = F.substring(F.lit("ACGTACGT"), F.instr(F.lit("ACGT"), own) + 1 + F.floor(_draw(*key, i, F.lit(2)) * 3).cast("int"), F.lit(1))
        return F.when(u < sub, other).when(u < gone, F.lit("")).when(u < ins, F.concat(_base(_draw(*key, i, F.lit(3))), own)).otherwise(own)

    return F.when(F.length(seq) == 0, seq).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(seq)), step), ""))


def sampled(seq: Column, model: PairModel, *key: Column) -> Column:
    """A read drawn from a pair-HMM: a fold over moves between match, insertion and deletion until the sequence is used up.

    An insertion uses no base of the sequence; a read has at most twice as many moves as the sequence has bases, and 50.
    """
    numbers = lambda x: F.array(*[F.lit(float(v)) for v in np.asarray(x).ravel()])
    moves, emits, inserts = numbers(np.cumsum(model.t, 1)), numbers(np.cumsum(model.e, 1)), numbers(np.cumsum(model.i, 1))
    code = lambda c: F.greatest(F.instr(F.lit("ACGT"), c) - 1, F.lit(0))

    def pick(table: Column, row: Column, width: int, u: Column) -> Column:
        """The first column whose cumulative share exceeds u."""
        over = [(F.element_at(table, row * width + c + 1) <= u).cast("int") for c in range(width - 1)]
        return sum(over[1:], over[0])

    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("state"), F.lit("").alias("out"))

    def step(s: Column, i: Column) -> Column:
        state = pick(moves, s["state"], 3, _draw(*key, i, F.lit(21)))
        u = _draw(*key, i, F.lit(22))
        last = F.when(s["out"] == "", F.lit(4)).otherwise(code(F.substring(s["out"], -1, 1)))
        base = F.when(state == 0, pick(emits, code(F.substring(seq, s["at"], F.lit(1))), 4, u)).otherwise(pick(inserts, last, 4, u))
        grown = F.when(state == 2, s["out"]).otherwise(F.concat(s["out"], F.substring(F.lit("ACGT"), base + 1, F.lit(1))))
        done = s["at"] > F.length(seq)
        return F.struct(F.when(done | (state == 1), s["at"]).otherwise(s["at"] + 1).alias("at"), F.when(done, s["state"]).otherwise(state).alias("state"), F.when(done, s["out"]).otherwise(grown).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), 2 * F.length(seq) + 50), start, step, lambda s: s["out"])


def with_errors(seq: Column, sub: int, deletion: int, ins: int, *key: Column) -> Column:
    """Exactly so many errors, at distinct places drawn by hash order (as far as the sequence has bases)."""
    order = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(seq)), lambda i: F.struct(F.xxhash64(*key, i, F.lit(5)).alias("h"), i.alias("i"))))
    places = F.transform(F.slice(order, 1, sub + deletion + ins), lambda s: s["i"])

    def step(i: Column) -> Column:
        rank, own = F.array_position(places, i), F.substring(seq, i, F.lit(1))
        other = F.substring(F.lit("ACGTACGT"), F.instr(F.lit("ACGT"), own) + 1 + F.floor(_draw(*key, i, F.lit(2)) * 3).cast("int"), F.lit(1))
        return F.when(rank == 0, own).when(rank <= sub, other).when(rank <= sub + deletion, F.lit("")).otherwise(F.concat(_base(_draw(*key, i, F.lit(3))), own))

    return F.when(F.length(seq) == 0, seq).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(seq)), step), ""))


def simulate_reads(templates: DataFrame, key: str, seq: str, depth: int, profile: Profile, seed: int = 0) -> DataFrame:
    """(key, read_idx, read): `depth` noisy reads of each template."""
    rows = templates.select(key, seq, F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("read_idx"))
    return rows.select(key, "read_idx", noisy(F.col(seq), profile, F.col(key), F.col("read_idx"), F.lit(seed)).alias("read"))
