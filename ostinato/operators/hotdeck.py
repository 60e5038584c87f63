"""Filling missing values from similar records: nearest-neighbour hot deck.

Each field names levels of observed columns, from the most specific to none at all. Records are hashed by
the columns of a level; a record that lacks the value goes to the first level at which at least K donors
agree with it (else the first with any). A block of more than BLOCK_ROWS donors, or recipients, is searched in
parts of about that many, dealt by key, to spread the work: each part of the recipients meets each part of the
donors, and of the K closest of each the K closest of all are kept, so the result is that of the whole block.
Within its block the K closest donors are found by a mixed distance: numeric features in units of their
interquartile range (a missing one counts FAR, none more than four times that), 1 for each categorical feature
that differs or is missing. Numbers take the median of the
donors weighted by closeness, categories the weighted majority; ties go to the smaller key or value.

Records with a null key are left out; copies of a key count once. Without any donor the value stays null
and n_donors is 0. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.session import broadcast_if_small, checkpointed, parts_for

K = 5
BLOCK_ROWS = 2048
ROWS_A_BUCKET = 50_000
CHUNK = 1 << 18  # pairs of a recipient and a donor that are compared at a time
FAR = 2.0
FILLED = "key long, field string, number double, category string, level int, n_donors int, donors array<long>"
NEAREST = "key long, field string, level int, near array<struct<distance:double,donor:long,number:double,category:string>>"
_NEAR = pa.struct([("distance", pa.float64()), ("donor", pa.int64()), ("number", pa.float64()), ("category", pa.string())])


@dataclass(frozen=True)
class Field:
    """value: a column, null where the value is missing; levels: names of the columns hashed at each level."""

    value: Column
    levels: Sequence[Sequence[str]]
    numeric: bool = True


@dataclass(frozen=True)
class Plan:
    fields: Mapping[str, Field]
    numbers: Sequence[str] = field(default_factory=tuple)
    categories: Sequence[str] = field(default_factory=tuple)
    rank_by: str | None = None  # has no effect: parts of a block are dealt by key


def _closest(distance: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the n smallest of each row, ascending; of equal ones the first."""
    if distance.shape[1] > n:
        held = distance <= np.partition(distance, n - 1, axis=1)[:, n - 1, None]
    else:
        held = np.ones(distance.shape, dtype=bool)
    row, column = np.nonzero(held)
    by = np.lexsort((column, distance[row, column], row))
    row, column = row[by], column[by]
    first = np.searchsorted(row, np.arange(len(distance)))
    kept = np.arange(len(row)) - first[row] < n
    return row[kept], column[kept]


def _lists(column: pa.ChunkedArray, width: int, kind) -> np.ndarray:
    """Lists of the same length as rows; nulls in them are NaN."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _search_part(numbers: np.ndarray, categories: np.ndarray, ask: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The K closest donors of each recipient, or as many as there are: place in ask, row of the donor, distance.

    numbers and categories: of all rows, donors of a part side by side and by key; first, count: where those of each recipient are.
    """
    rows, found, far = [], [], []
    lo = 0
    while lo < len(ask):
        # Recipients come by rising number of donors: those of a chunk have nearly as many.
        most = np.maximum.accumulate(count[lo:]) * np.arange(1, len(ask) - lo + 1)
        hi = lo + max(1, int(np.searchsorted(most, CHUNK, side="right")))
        me, width = ask[lo:hi], int(count[hi - 1])
        at = np.arange(width)
        there = at < count[lo:hi, None]
        donor = np.minimum(first[lo:hi, None] + at, len(numbers) - 1)
        d = np.where(there, 0.0, np.inf)
        for j in range(numbers.shape[1]):
            step = np.abs(numbers[me, j][:, None] - numbers[:, j][donor])
            d += np.where(np.isnan(step), FAR, np.minimum(step, 4 * FAR))
        for j in range(categories.shape[1]):
            own = categories[me, j][:, None]
            d += (own != categories[:, j][donor]) | (own == 0)
        row, column = _closest(d, K)
        real = there[row, column]
        row, column = row[real], column[real]
        rows.append(row + lo)
        found.append(donor[row, column])
        far.append(d[row, column])
        lo = hi
    return np.concatenate(rows), np.concatenate(found), np.concatenate(far)


def _searcher(numbers: int, categories: int):
    schema = pa.schema([("key", pa.int64()), ("field", pa.string()), ("level", pa.int32()), ("near", pa.list_(_NEAR))])

    def search(data: pa.Table) -> pa.Table:
        column = {c: data.column(c).to_numpy() for c in ("hash", "part", "ask_part", "donor", "key")}
        by = np.lexsort((column["key"], ~column["donor"], column["ask_part"], column["part"], column["hash"]))  # donors first
        data = data.take(pa.array(by))
        column = {c: x[by] for c, x in column.items()}
        new = np.ones(len(by), dtype=bool)
        for i, c in enumerate(("hash", "part", "ask_part")):
            same = column[c][1:] == column[c][:-1]
            new[1:] = ~same if i == 0 else new[1:] | ~same
        group = np.cumsum(new) - 1
        donors = np.bincount(group, weights=column["donor"]).astype(np.int64)
        ask = np.flatnonzero(~column["donor"])
        if not len(ask):
            return schema.empty_table()
        ask = ask[np.argsort(donors[group[ask]], kind="stable")]
        first = np.flatnonzero(new)[group[ask]]
        row, donor, far = _search_part(_lists(data.column("numbers"), numbers, float), _lists(data.column("categories"), categories, np.int64), ask, first, donors[group[ask]])
        taken = data.select(["key", "number", "category"]).take(pa.array(donor)).combine_chunks()
        near = pa.StructArray.from_arrays([pa.array(far, pa.float64()), *(taken.column(c).combine_chunks().cast(_NEAR.field(i + 1).type) for i, c in enumerate(taken.column_names))], fields=list(_NEAR))
        offsets = np.searchsorted(row, np.arange(len(ask) + 1)).astype(np.int32)
        mine = data.select(["key", "field", "level"]).take(pa.array(ask))
        return pa.table([*mine.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), near)], names=schema.names).cast(schema)

    return search


def _filled(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The value of each recipient (key, field, level, near) from its donors."""
    schema = pa.schema([("key", pa.int64()), ("field", pa.string()), ("number", pa.float64()), ("category", pa.string()), ("level", pa.int32()), ("n_donors", pa.int32()), ("donors", pa.list_(pa.int64()))])
    for batch in data:
        number, category, donors = [], [], []
        for near in batch.column("near").to_pylist():
            weight = [1.0 / (x["distance"] + 0.05) for x in near]
            donors.append([x["donor"] for x in near])
            middle = kind = None
            if near and near[0]["category"] is None:
                by = np.argsort(values := np.array([x["number"] for x in near], dtype=float), kind="stable")
                upto = np.cumsum(np.array(weight)[by])
                middle = float(values[by[(upto >= upto[-1] / 2).argmax()]])
            elif near:
                votes: dict[str, float] = {}
                for x, w in zip(near, weight, strict=True):
                    votes[x["category"]] = votes.get(x["category"], 0.0) + w
                kind = min(votes, key=lambda v: (-votes[v], v))
            number.append(middle)
            category.append(kind)
        columns = [batch.column("key"), batch.column("field"), pa.array(number, pa.float64()), pa.array(category, pa.string()), batch.column("level"), pa.array([len(x) for x in donors], pa.int32()), pa.array(donors, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def hot_deck(df: DataFrame, key: str, plan: Plan) -> DataFrame:
    """One row for each missing value: key, field, number or category, level, n_donors, donors (their keys)."""
    scale = {n: 1.0 for n in plan.numbers}
    asked = [F.percentile_approx(n, [0.25, 0.75], 1000).alias(f"q_{n}") for n in plan.numbers]
    if asked:  # one row of bounded size
        row = df.agg(*asked).first()
        scale = {n: ((q[1] - q[0]) or 1.0) if (q := row[f"q_{n}"]) else 1.0 for n in plan.numbers}
    values = []
    for name, f in plan.fields.items():
        levels = [
            F.when(
                _all_there(cols),
                F.struct(F.lit(i).alias("level"), F.xxhash64(F.lit(name), F.lit(i), *cols).alias("hash")),
            )
            for i, cols in enumerate(f.levels)
        ]
        values.append(
            F.struct(
                F.lit(name).alias("field"),
                (f.value.cast("double") if f.numeric else F.lit(None).cast("double")).alias("number"),
                (F.lit(None).cast("string") if f.numeric else f.value.cast("string")).alias("category"),
                f.value.isNotNull().alias("donor"),
                F.array_compact(F.array(*levels)).alias("levels"),
            )
        )
    # Only the rows of keys that have copies are shuffled to be told apart.
    keyed = df.filter(F.col(key).isNotNull())
    copies = broadcast_if_small(checkpointed(keyed.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key)))
    once = keyed.join(copies, key, "left_anti").unionByName(keyed.join(copies, key, "left_semi").dropDuplicates([key]))
    no_numbers, no_categories = F.array().cast("array<double>"), F.array().cast("array<long>")
    # Written once: it is read for the counts, the donors and the records that lack a value.
    base = checkpointed(
        once.select(
            F.col(key).cast("long").alias("key"),
            (F.array(*[(F.col(n) / scale[n]).cast("double") for n in plan.numbers]) if plan.numbers else no_numbers).alias("numbers"),
            (F.array(*[F.when(F.col(c).isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(c)) for c in plan.categories]) if plan.categories else no_categories).alias("categories"),
            F.array(*values).alias("values"),
        )
    )
    records = base.select("key", "numbers", "categories", F.explode("values").alias("x")).select("key", "numbers", "categories", "x.*")
    by_level = records.select("*", F.explode("levels").alias("at")).select(
        "key", "numbers", "categories", "field", "number", "category", "donor", "at.level", "at.hash"
    )
    donors = by_level.filter("donor").drop("levels")
    counts = donors.groupBy("field", "level", "hash").agg(F.count("*").alias("n"))
    # The first level with K donors, else the first with any, else the last.
    best = F.min(F.struct((F.col("n") < K).cast("int"), (F.col("n") == 0).cast("int"), "level", "hash", "n")).alias("best")
    lacking = (
        by_level.filter("NOT donor")
        .select("key", "field", "level", "hash")
        .join(counts, ["field", "level", "hash"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .groupBy("key", "field")
        .agg(best)
        .select("key", "field", "best.level", "best.hash", "best.n")
    )
    lacking = checkpointed(lacking)
    # Only blocks that are asked for are read; where few are, donors are filtered before any shuffle.
    used = lacking.groupBy("field", "level", "hash", "n").agg(F.count("*").alias("m"))
    used = used.withColumn("parts", F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.lit(1))).withColumn("ask_parts", F.ceil(F.col("m") / BLOCK_ROWS))
    used = checkpointed(used)
    rows = used.agg(F.sum(F.col("m") * F.col("parts") + F.col("n") * F.col("ask_parts"))).first()[0] or 0
    buckets = parts_for(rows, ROWS_A_BUCKET)
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 8)
    used = broadcast_if_small(used.drop("n", "m"))
    columns = ["key", "numbers", "categories", "field", "number", "category", "donor", "level", "hash", "part", "ask_part"]
    dealt = lambda parts: F.pmod(F.xxhash64("key", F.lit(7)), F.col(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    give = donors.join(used, ["field", "level", "hash"]).withColumn("part", dealt("parts")).withColumn("ask_part", every("ask_parts"))
    ask = lacking.join(used, ["field", "level", "hash"]).join(
        records.filter("NOT donor").select("key", "field", "numbers", "categories", "number", "category", "donor"), ["key", "field"]
    )
    ask = ask.withColumn("ask_part", dealt("ask_parts")).withColumn("part", every("parts"))
    near = (
        give.select(*columns)
        .unionByName(ask.select(*columns))
        .withColumn("bucket", F.pmod(F.xxhash64("field", "level", "hash", "part", "ask_part"), F.lit(buckets)))
        .repartition(tasks, "bucket")
        .groupBy("bucket")
        .applyInArrow(_searcher(len(plan.numbers), len(plan.categories)), NEAREST)
    )
    # Structs sort by distance, then by the donor's key.
    best = near.groupBy("key", "field").agg(F.first("level").alias("level"), F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, K).alias("near"))
    return best.select("key", "field", "level", "near").mapInArrow(_filled, FILLED)


def _all_there(cols: Sequence[str]) -> Column:
    there = F.lit(True)
    for c in cols:
        there = there & F.col(c).isNotNull()
    return there


def number_or_null(c: str, above: float, most: float) -> Column:
    """c where it can be a measured value, above `above` and at most `most`; null for null, NaN and stand-ins."""
    x = F.col(c)
    return F.when(~F.isnan(x) & (x > above) & (x <= most), x)


def category_or_null(c: str, known: Sequence[str]) -> Column:
    """c in lower case without outer blanks if it is one of `known`, else null."""
    x = F.lower(F.trim(c))
    return F.when(x.isin(*known), x)


#: What a played note can have: f0 in Hz and external amplitude in Pa, above the first and up to the second; instrument.
NOTE_LIMITS = {"f0_avg": (59.999, 1600.0), "ext_ampl_avg": (0.0, 120.0)}
INSTRUMENTS = ("lab", "own")


def fill_notes(notes: DataFrame) -> DataFrame:
    """Missing f0_avg, ext_ampl_avg and instrument of notes, filled from similar notes; see hot_deck for the columns."""
    from ostinato.session import path_key

    f0, ampl = (number_or_null(c, *NOTE_LIMITS[c]) for c in ("f0_avg", "ext_ampl_avg"))
    instrument = category_or_null("instrument", INSTRUMENTS)
    label = F.regexp_extract("note_label", r"-\s*([A-G]#?\d)\s*$", 1)
    n = notes.select(
        "note_key",
        f0.alias("f0"),
        ampl.alias("ampl"),
        instrument.alias("instrument"),
        path_key("wavfile").alias("file"),
        F.regexp_extract(path_key("wavfile"), r"^(.*)/[^/]*$", 1).alias("folder"),
        F.regexp_extract(path_key("wavfile"), r"/([^/]*)/[^/]*$", 1).alias("place"),
        "ver_nbr",
        "subject_id",
        "tune",
        "note_id",
        F.when(label != "", label).alias("pitch"),
        F.log(F.col("note_end") - F.col("note_start")).alias("log_duration"),
        F.log(F.nanvl(ampl, F.lit(None))).alias("log_ampl"),
        F.log(f0).alias("log_f0"),
        F.nanvl(F.col("ext_ampl_var"), F.lit(None)).alias("ampl_var"),
    )
    plan = Plan(
        {
            "f0_avg": Field(F.col("f0"), [["file", "pitch"], ["file", "tune", "note_id"], ["subject_id", "pitch"], ["tune", "note_id"], ["pitch"], ["subject_id"], []]),
            "ext_ampl_avg": Field(F.col("ampl"), [["file", "ver_nbr"], ["file"], ["subject_id", "instrument"], ["tune", "note_id"], []]),
            "instrument": Field(F.col("instrument"), [["file"], ["folder"], ["place"], ["subject_id"], ["tune"], []], numeric=False),
        },
        numbers=["log_duration", "log_ampl", "log_f0", "ampl_var"],
        categories=["ver_nbr", "subject_id", "instrument", "tune", "note_id", "pitch", "file"],
        rank_by="log_duration",
    )
    return hot_deck(n, "note_key", plan).withColumnRenamed("key", "note_key")
