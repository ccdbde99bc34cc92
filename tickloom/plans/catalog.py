"""A catalog of collections as parquet partitioned by type and folder: merge, totals, search, sort, tags, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import canonical_name, tag_added, tag_removed, team_text

#: Rows of the sample that cuts an order into ranges.
SAMPLE = 4096
PARTITIONS = ("type", "folder")
TYPES = ("SINGLE", "DOUBLE", "TRIPLE", "QUAD", "ACE", "MULTI")
#: Columns of a row with tick data that a later row without it does not overwrite.
PROTECTED = ("tick_data", "col_total", "start_kill_tick", "end_kill_tick")


def write(df: DataFrame, path: str, mode: str = "append") -> None:
    """One shuffle to the partitions' values with a salt, so that a large folder is many files and no task holds it whole."""
    parts = [c for c in PARTITIONS if c in df.columns]
    df.withColumn("__salt", F.pmod(F.xxhash64(*[c for c in df.columns if c not in parts][:3]), F.lit(16))).repartition(*parts, "__salt").drop("__salt").write.mode(mode).partitionBy(*parts).parquet(path)


def merge(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_if_empty: Sequence[str] = ("tag",), protected: Sequence[str] = (), guard: str | None = None) -> DataFrame:
    """Upsert: new rows replace old ones of the same key (nulls are equal).

    keep_if_empty: an empty or null new value keeps the old one. protected: kept from the old row where `guard` is 1 there and not in the new row.
    Several new rows of one key are an error of the caller; unique() finds them.
    """
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns], F.lit(True).alias("__old"))
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns], F.lit(True).alias("__new"))
    cond = None
    for k in keys:
        one = F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}"))
        cond = one if cond is None else cond & one
    both = o.join(n, cond, "full")
    held = (F.col(f"o_{guard}") == 1) & (F.coalesce(F.col(f"n_{guard}"), F.lit(0)) != 1) if guard else F.lit(False)

    def value(c: str) -> Column:
        fresh, before = (F.col(f"n_{c}") if c in new.columns else F.lit(None)), F.col(f"o_{c}")
        if c in keep_if_empty:
            fresh = F.when(F.coalesce(F.trim(fresh.cast("string")), F.lit("")) != "", fresh).otherwise(before)
        if c in protected:
            fresh = F.when(held, before).otherwise(fresh)
        return F.when(F.col("__new"), fresh).otherwise(before).alias(c)

    return both.select(*[value(c) for c in old.columns])


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def totals(df: DataFrame, demo: str = "demo_name", player: str = "steam_id") -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_distinct(demo).alias("demos"), F.count_distinct(player).alias("players"))


def group_totals(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))


def weapon_totals(df: DataFrame, weapons: str, sep: str = ";") -> DataFrame:
    """Occurrences of each weapon in a text list, and in how many rows it is the only one."""
    listed = df.select(F.transform(F.split(weapons, sep), lambda x: F.trim(x)).alias("w")).withColumn("__one", (F.size(F.array_distinct("w")) == 1))
    each = listed.select("__one", F.posexplode("w").alias("__i", "weapon")).where("weapon <> ''")
    return each.groupBy("weapon").agg(F.count("*").alias("n"), F.sum((F.col("__one") & (F.col("__i") == 0)).cast("int")).alias("exclusive"))


def folder_stats(df: DataFrame, folder: str = "folder", demo: str = "demo_name", enabled: str = "enabled") -> DataFrame:
    return df.groupBy(folder).agg(F.count_distinct(demo).alias("demos"), F.sum(F.col(enabled).cast("int")).alias("enabled"), F.count("*").alias("n"))


def by_type(df: DataFrame, type: str = "type") -> DataFrame:
    return df.groupBy(type).agg(F.count("*").alias("n"))


def largest_per_demo(df: DataFrame, demo: str = "demo_name") -> DataFrame:
    return df.groupBy(demo).agg(F.coalesce(F.max("col_total"), F.lit(0)).alias("col_total"), F.max("collection_num").alias("collection_num"))


def largest_version(df: DataFrame, version: str = "version") -> DataFrame:
    return df.agg(F.coalesce(F.max(version), F.lit(0)).alias("version"))


def enabled_only(df: DataFrame, types: Sequence[str], folders: Sequence[str]) -> DataFrame:
    """Rows of enabled types and folders: partition columns, so other files are not read. None enabled: nothing."""
    if not types or not folders:
        return df.limit(0)
    return df.where(F.col("type").isin(*types) & F.col("folder").isin(*folders))


def with_tick_data(df: DataFrame, mode: str = "all", column: str = "tick_data") -> DataFrame:
    """all, with or without; a table that lacks the column has no row with tick data."""
    if mode == "all":
        return df
    has = F.coalesce(F.col(column) == 1, F.lit(False)) if column in df.columns else F.lit(False)
    return df.where(has if mode == "with" else ~has)


def search(df: DataFrame, text: str, fields: Sequence[str]) -> DataFrame:
    """Comma means or; `!x`: x is not there; an empty term is true. Compared in lower case over the fields together."""
    everything = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]))
    if not text.strip():
        return df
    cond = None
    for term in (t.strip().lower() for t in text.split(",")):
        one = F.lit(True) if term in ("", "!") else ~everything.contains(term[1:].strip()) if term[0] == "!" else everything.contains(term)
        cond = one if cond is None else cond | one
    return df.where(cond)


def sort(df: DataFrame, key: str, tie: Sequence[str], descending: bool = True, rank: str | None = None, parts: int = 64) -> DataFrame:
    """By one key (text without regard to case), then by tie. rank: adds the place as a column instead of ordering rows.

    Places are found without one order of all rows: a sample of SAMPLE rows, chosen by hash, gives bounds that cut the keys into ranges (a
    key that is a bound is a range of its own, cut again by tie); places within a range follow the number of rows in the ranges before.
    """
    col = F.lower(F.col(key)) if dict(df.dtypes)[key] == "string" else F.col(key)
    if not rank:
        return df.orderBy(col.desc() if descending else col.asc(), *tie)
    rows = df.withColumn("__key", col).withColumn("__tie", F.struct(*tie))
    sample = rows.select("__key", "__tie").orderBy(F.xxhash64("__key", "__tie"), "__key", "__tie").limit(SAMPLE)
    # one row: every (SAMPLE / parts)-th of the sample's sorted keys and ties
    every = max(1, SAMPLE // parts)
    pick = lambda c: F.transform(F.filter(F.transform(F.sort_array(F.collect_list(c)), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda e: e["i"] % every == every - 1), lambda e: e["x"])
    bounds = sample.agg(pick("__key").alias("__keys"), pick("__tie").alias("__ties"))
    below = lambda c, array: F.size(F.filter(array, lambda b: b < F.col(c)))
    own = F.coalesce(F.array_contains("__keys", F.col("__key")), F.lit(False))
    # null keys come first going up and last going down, as Spark sorts them
    number = F.when(F.col("__key").isNull(), -1).otherwise(2 * below("__key", "__keys") + own.cast("int"))
    ranged = rows.crossJoin(F.broadcast(bounds)).withColumn("__a", number).withColumn("__b", F.when(own, below("__tie", "__ties")).otherwise(0)).drop("__keys", "__ties")
    a = F.col("__a").desc() if descending else F.col("__a").asc()
    counts = ranged.groupBy("__a", "__b").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(a, "__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most 2 x parts² rows
    placed = ranged.join(F.broadcast(counts.select("__a", "__b", before.alias("__before"))), ["__a", "__b"])
    inside = Window.partitionBy("__a", "__b").orderBy(F.col("__key").desc() if descending else F.col("__key").asc(), *tie)
    return placed.withColumn(rank, (F.col("__before") + F.row_number().over(inside)).cast("int")).select(*df.columns, rank)


def distinct_tags(df: DataFrame, tag: str = "tag") -> DataFrame:
    return df.where(F.coalesce(F.trim(tag), F.lit("")) != "").select(F.trim(tag).alias(tag)).distinct()


def add_tag(df: DataFrame, where: Column, tag: str, column: str = "tag") -> DataFrame:
    return df.withColumn(column, F.when(where, tag_added(F.col(column), tag)).otherwise(F.col(column)))


def remove_tag(df: DataFrame, where: Column, tag: str, column: str = "tag") -> DataFrame:
    return df.withColumn(column, F.when(where, tag_removed(F.col(column), tag)).otherwise(F.col(column)))


def invalid(df: DataFrame, required: Sequence[str], ranges: dict[str, tuple[float, float]] | None = None, same_length: Sequence[str] = ()) -> DataFrame:
    """Rows that break a rule, with the rules' names in `problems`."""
    checks = [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(f"{c} is empty")) for c in required]
    if "type" in df.columns:
        checks.append(F.when(~F.col("type").isin(*TYPES), F.lit("type is unknown")))
    if "steam_id" in df.columns:
        checks.append(F.when(~F.col("steam_id").cast("string").rlike(r"^\d{17}$"), F.lit("steam_id is malformed")))
    for c, (low, high) in (ranges or {}).items():
        checks.append(F.when(~F.col(c).between(low, high), F.lit(f"{c} is out of range")))
    for c in same_length[1:]:
        checks.append(F.when(F.size(c) != F.size(same_length[0]), F.lit(f"{c} has another length")))
    return df.withColumn("problems", F.array_compact(F.array(*checks))).where(F.size("problems") > 0)


def clips(collections: DataFrame, assets: DataFrame, sources: DataFrame) -> DataFrame:
    """Collections with their assets and, where known, sources. Assets and collections are joined on the same keys they are stored by."""
    return collections.join(assets, ["demo_name", "collection_num"]).join(sources, "demo_name", "left")


def without_current_asset(collections: DataFrame, assets: DataFrame, format: str) -> DataFrame:
    """Collections that have no asset of the format: the right side is filtered before the join."""
    return collections.join(assets.where(F.col("format") == format), ["demo_name", "collection_num"], "left_anti")


def resolved(filters: DataFrame, paths: DataFrame, path: str = "demo_path") -> DataFrame:
    """Paths that a filter selects: an exact path first, else a stem that only one path has; others are left out."""
    named = paths.withColumn("__stem", canonical_name(F.col(path))).withColumn("__n", F.count("*").over(Window.partitionBy("__stem")))
    exact = named.join(filters.select(F.col("path").alias(path), "collections"), path)
    rest = filters.join(paths.select(F.col(path).alias("path")), "path", "left_anti").withColumn("__stem", canonical_name(F.col("path")))
    by_stem = named.where("__n = 1").join(rest.select("__stem", "collections"), "__stem")
    return exact.select(path, "collections").unionByName(by_stem.select(path, "collections")).dropDuplicates([path])


def updated(df: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """df with columns of the matching change row where that has a value; rows without a change stay as they are."""
    c = changes.select(*keys, *[F.col(x).alias(f"__{x}") for x in columns])
    return df.join(c, list(keys), "left").select(*[F.coalesce(f"__{x}", x).alias(x) if x in columns else F.col(x) for x in df.columns])


def filled_where_null(df: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A guarded backfill: only cells that are null take the change row's value."""
    c = changes.select(*keys, *[F.col(x).alias(f"__{x}") for x in columns])
    return df.join(c, list(keys), "left").select(*[F.coalesce(x, f"__{x}").alias(x) if x in columns else F.col(x) for x in df.columns])


def tick_data_enabled(df: DataFrame, found: DataFrame, keys: Sequence[str], column: str = "tick_data") -> DataFrame:
    """1 where the asset is there, 0 elsewhere: reset and enable in one pass."""
    there = found.select(*keys).distinct().withColumn("__there", F.lit(1))
    return df.join(there, list(keys), "left").withColumn(column, F.coalesce("__there", F.lit(0))).drop("__there")


def migrated(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with the columns that an older version lacks, as null, in the declared order and types; unknown columns go last."""
    known = [(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()]
    return df.select(*known, *[c for c in df.columns if c not in columns])


def manifest(df: DataFrame, by: Sequence[str] = ("type", "folder"), demo: str = "demo_name", player: str = "steam_id") -> DataFrame:
    """by and `manifest`: each catalog's totals as a JSON text, for a file beside it."""
    each = df.groupBy(*by).agg(F.count("*").alias("collections"), F.count_distinct(demo).alias("demos"), F.count_distinct(player).alias("players"))
    return each.select(*by, F.to_json(F.struct(*by, "collections", "demos", "players")).alias("manifest"))


def completeness(df: DataFrame, demo: str = "demo_name", total: str = "col_total") -> DataFrame:
    """Per demo its rows, the number that it should have (0 where that is not known), and whether they are all there."""
    known = F.coalesce(F.max(total), F.lit(0)) if total in df.columns else F.lit(0)
    out = df.groupBy(demo).agg(F.count("*").alias("n"), known.alias("expected"))
    return out.withColumn("complete", (F.col("expected") > 0) & (F.col("n") >= F.col("expected")))


def collection_key(killer: Column, demo: Column, round: Column, start: Column, end: Column) -> Column:
    """The text that tells a collection from all others; nulls count as empty."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (killer, demo, round, start, end)])


def sanitised(df: DataFrame, texts: Sequence[str], lists: Sequence[str] = (), demo: str | None = None, teams: Sequence[str] = (), parallel: Sequence[str] = ()) -> DataFrame:
    """df with texts trimmed, empty entries of lists gone, the demo's name canonical, teams in their usual spelling.

    parallel: arrays that belong together, sorted by the first; shorter ones end in nulls.
    """
    done = {c: F.trim(c) for c in texts} | {c: F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "") for c in lists}
    done |= {c: team_text(F.trim(c)) for c in teams} | ({demo: canonical_name(F.trim(demo))} if demo else {})
    out = df.withColumns(done)
    if parallel:
        rows = F.array_sort(F.arrays_zip(*parallel))
        out = out.withColumn("__rows", rows).withColumns({c: F.col("__rows")[c] for c in parallel}).drop("__rows")
    return out


def relative_folder(path: Column, base: str) -> Column:
    """The path below base; of other paths the parent folder's name and a slash."""
    whole = F.replace(path, F.lit("\\"), F.lit("/"))
    parent = F.regexp_extract(whole, r"([^/]+)/[^/]*$", 1)
    outside = F.when(parent == "", "").otherwise(F.concat(parent, F.lit("/")))
    return F.when(whole.startswith(base), F.substring(whole, F.lit(len(base) + 1), F.length(whole))).otherwise(outside) if base else outside


def prefer_saved(sources: DataFrame, saved: DataFrame, keys: Sequence[str], path: str = "path") -> DataFrame:
    """sources with the saved clip's path where one is registered, and whether it is one."""
    own = saved.groupBy(*keys).agg(F.min(path).alias("__saved"))
    return sources.join(own, list(keys), "left").withColumn("saved", F.col("__saved").isNotNull()).withColumn(path, F.coalesce("__saved", path)).drop("__saved")


def same_tick(ticks: Column, n: int) -> Column:
    """n = 2: whether these are two kills of one tick; n > 2: whether some tick has so many."""
    if n == 2:
        return (F.size(ticks) == 2) & (ticks[0] == ticks[1])
    return F.exists(ticks, lambda t: F.size(F.filter(ticks, lambda x: x == t)) >= n)
