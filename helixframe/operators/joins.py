"""Enrichment joins. Join strategy is left to the optimizer and AQE unless a side is counted."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from helixframe.constants import AF_EPSILON, CONSTRAINT_COLUMNS
from helixframe.operators.dedup import keep_first
from helixframe.operators.ordered import medians_wide
from helixframe.session import cut_lineage, small_side

AF_DEFAULTS = {"AF": 0.0, "AF_popmax": 0.0, "log_AF": math.log10(AF_EPSILON), "is_common": False}


def join_inner_validated(left, right, key="variant_key", order: Sequence = (), drop: Sequence[str] = (), validate: bool = True):
    """Inner join one-to-one on the key; right columns that the left side owns are dropped.

    Keys that repeat on the left raise, and so does a join without any row. On the right, `order`
    declares which of several rows of a key is meant (the first); without it repeated keys raise
    there too. The keys of both sides are aggregated once for these checks; `validate=False` leaves
    them out where the caller has made the keys unique. `join_report` has the counts.
    """
    owned = set(left.columns) | set(drop)
    if validate:
        report = join_report(left, right, key).first()
        if report["n_left_repeated"] or (report["n_right_repeated"] and not order):
            raise ValueError(f"repeated keys: {report['n_left_repeated']} left, {report['n_right_repeated']} right")
        if not report["n_matched"]:
            raise ValueError(f"no key of {report['n_left']} rows matches")
    right = right.select(key, *[c for c in right.columns if c != key and c not in owned])
    order = [o for o in order if not isinstance(o, str) or o in right.columns] or [
        c for c in right.columns if c != key
    ]
    return left.join(keep_first(right, [key], order), key)


def join_report(left, right, key="variant_key") -> DataFrame:
    """One row: rows and keys of both sides, repeated keys, matched and filtered (unmatched) left rows."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    ).filter(F.col(key).isNotNull())
    per_key = sides.groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    both = (F.col("l") > 0) & (F.col("r") > 0)

    def total(c):
        return F.coalesce(F.sum(c), F.lit(0))

    return per_key.agg(
        total("l").alias("n_left"), total("r").alias("n_right"),
        F.count_if(F.col("l") > 1).alias("n_left_repeated"), F.count_if(F.col("r") > 1).alias("n_right_repeated"),
        total(F.when(both, F.col("l"))).alias("n_matched"), total(F.when(F.col("r") == 0, F.col("l"))).alias("n_filtered"),
    )


def assert_one_to_one(df: DataFrame, key: str, table: str) -> DataFrame:
    """Fail on repeated keys or an empty table; one aggregate."""
    repeated, rows = (
        df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count_if(F.col("n") > 1), F.count(F.lit(1))).first()
    )
    if repeated or not rows:
        raise ValueError(f"{table}: {repeated} repeated keys, {rows} keys")
    return df


def join_left_defaults(left, freq, key="variant_key") -> DataFrame:
    """Left join of allele frequencies. Defaults follow the *match*, not the value: a matched row
    with NULL AF keeps it, while AN and AC are filled either way."""
    flagged = freq.withColumn("_hit", F.lit(True))
    out = left.join(flagged, key, "left")
    miss = F.col("_hit").isNull()
    fixes = {
        c: F.when(miss, F.lit(v)).otherwise(F.col(c)) for c, v in AF_DEFAULTS.items() if c in freq.columns
    }
    fixes |= {c: F.coalesce(F.col(c), F.lit(0).cast(out.schema[c].dataType)) for c in ("AN", "AC") if c in freq.columns}
    if "is_common" in fixes:
        fixes["is_common"] = F.coalesce(fixes["is_common"], F.lit(False))
    return out.withColumns(fixes).drop("_hit")


def join_flagged(left, right, on, flag: str) -> DataFrame:
    """Left join with a boolean column telling whether the right side matched."""
    out = left.join(right.withColumn("_hit", F.lit(True)), on, "left")
    return out.withColumn(flag, F.col("_hit").isNotNull()).drop("_hit")


def constraint_medians(variants, constraint, columns=CONSTRAINT_COLUMNS, gene="gene") -> DataFrame:
    """One row: exact medians over variants whose gene is known."""
    columns = [c for c in columns if c in constraint.columns]
    return medians_wide(variants.select(gene).join(constraint, gene), columns)


def fill_from_row(df: DataFrame, medians: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Coalesce each column with the matching value of a one-row table."""
    named = medians.select(*[F.col(c).alias(f"_m_{c}") for c in columns])
    out = df.join(F.broadcast(named), F.lit(True), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in columns}).drop(
        *[f"_m_{c}" for c in columns]
    )


def join_gene_impute(
    variants, constraint, medians: DataFrame | None = None, columns=CONSTRAINT_COLUMNS, gene="gene"
) -> DataFrame:
    """Gene-level features with median fill and a missing flag. Pass train medians for the
    other splits so that nothing is fitted on them."""
    columns = [c for c in columns if c in constraint.columns]
    medians = constraint_medians(variants, constraint, columns, gene) if medians is None else medians
    merged = join_flagged(variants, constraint, gene, "_known")
    filled = fill_from_row(merged, medians, columns)
    return filled.withColumn("is_imputed_constraint", (~F.col("_known")).cast("int")).drop("_known")


def join_split_coverage(left, right, key="variant_key") -> tuple[DataFrame, DataFrame]:
    """Matched rows with the right columns, and the unmatched rows. Overlapping right columns
    are dropped."""
    extra = [c for c in right.columns if c == key or c not in left.columns]
    return left.join(right.select(*extra), key), left.join(right.select(key), key, "left_anti")


def coverage_report(left, right, key="variant_key") -> DataFrame:
    hit = join_flagged(left.select(key), right.select(key).distinct(), key, "hit")
    return hit.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if("hit").alias("n_matched"),
        F.count_if(~F.col("hit")).alias("n_unmatched"),
        F.avg(F.col("hit").cast("double")).alias("coverage"),
    )


def join_semi_keys(left, keys, key="variant_key") -> DataFrame:
    return left.join(keys.select(key), key, "left_semi")


def join_anti_cache_miss(wanted, cache, key="variant_key") -> DataFrame:
    return wanted.join(cache.select(key), key, "left_anti")


def join_score_flag(left, scores, key="variant_key", score="score") -> DataFrame:
    out = left.join(scores.select(key, score), key, "left")
    return out.withColumn(f"is_imputed_{score}", F.col(score).isNull().cast("int"))


def join_paired_predictions(a, b, key="variant_key", keep=("label",), score="p") -> DataFrame:
    """Same rows under two models: label from `a`, scores `p_a` and `p_b`."""
    return a.select(key, *keep, F.col(score).alias("p_a")).join(
        b.select(key, F.col(score).alias("p_b")), key
    )


def join_multi_left(base, *tables, key="variant_key") -> DataFrame:
    for t in tables:
        base = base.join(t, key, "left")
    return base


def join_best_match(left, right, on: Sequence[str], prefer, order: Sequence[str], key="variant_key"):
    """One right row per left row: rows meeting `prefer` first, then `order`; NULLs if none.

    `left` holds one row per key and `prefer` is a boolean column over the joined rows. The
    candidates come from an inner join, where skewed keys may be split on either side, and
    combine map-side before the outer join sees one row per key.
    """
    extra = [c for c in right.columns if c not in on]
    place = F.struct((~F.coalesce(prefer, F.lit(False))).alias("o"), *[F.col(c) for c in order])
    best = (
        left.join(right, list(on)).groupBy(key)
        .agg(F.min_by(F.struct(*extra), place).alias("_row"))
    )
    return left.join(best, key, "left").select(*left.columns, "_row.*")


def join_holdout_flag(df, train, family_of, gene="gene") -> DataFrame:
    """`family_holdout` is true when the row's family never occurs in training."""
    seen = train.select(family_of(F.col(gene)).alias("_family")).distinct()
    tagged = df.withColumn("_family", family_of(F.col(gene)))
    out = tagged.join(seen.withColumn("_hit", F.lit(True)), "_family", "left")
    return out.withColumn("family_holdout", F.col("_hit").isNull()).drop("_family", "_hit")


def join_cascade_sources(wanted, sources: Sequence[tuple[str, DataFrame]], key="variant_key") -> DataFrame:
    """Per wanted key the row of the first source that has it, with the source name.

    Sources are stacked with a priority and combined in one aggregate per key.
    """
    stacked = None
    for rank, (name, table) in enumerate(sources):
        rows = table.withColumns({"_rank": F.lit(rank), "source": F.lit(name)})
        stacked = rows if stacked is None else stacked.unionByName(rows, allowMissingColumns=True)
    rest = [c for c in stacked.columns if c not in (key, "_rank")]
    hits = stacked.join(wanted.select(key).distinct(), key, "left_semi")
    first = hits.groupBy(key).agg(F.min_by(F.struct(*rest), "_rank").alias("_row"))
    return wanted.select(key).distinct().join(first, key, "left").select(key, "_row.*")


def join_gene_backfill(keys, primary, secondary, key="variant_key", gene="gene") -> DataFrame:
    """Gene from the primary table, else the secondary; rows without either are dropped."""
    a = primary.select(key, F.col(gene).alias("_g1"))
    b = secondary.select(key, F.col(gene).alias("_g2"))
    out = keys.join(a, key, "left").join(b, key, "left")
    return out.withColumn(gene, F.coalesce("_g1", "_g2")).drop("_g1", "_g2").filter(
        F.col(gene).isNotNull()
    )


def gene_lookup_from_rows(train, columns: Sequence[str], order: Sequence[str], gene="gene") -> DataFrame:
    """Rebuild the gene table: first known value per gene over rows that have any."""
    place = F.struct(*order)
    known = train.filter(F.coalesce(*[F.col(c) for c in columns]).isNotNull())
    return known.groupBy(gene).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns]
    )


#: Rows of a structure up to which it is worked on as one group; the points of larger ones go through an octree.
STRUCTURE_ROWS = 2048
#: Points that are compared at a time with those near them.
POINTS_AT_ONCE = 128
#: Point pairs of two nodes up to which the points are compared; larger pairs of nodes are split.
NODE_PAIRS = 1024
#: Levels of the octree below cells of side `radius`; nodes of the last are compared by points at any size.
DEEPEST = 12


def _node(radius: float, level: int):
    """Cell numbers of a point at a level, along each axis: cells of side radius / 2**level."""
    side = radius / (1 << level)
    return [F.floor(F.col(c) / F.lit(side)).cast("bigint") for c in "xyz"]


def by_size(rows: DataFrame, group: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups of at most STRUCTURE_ROWS rows, and those of larger groups (None if there are none)."""
    sizes = rows.groupBy(F.col(group).alias("_large")).agg(F.count(F.lit(1)).alias("n"))
    large = small_side(sizes.filter((F.col("n") > STRUCTURE_ROWS) & F.col("_large").isNotNull()).select("_large"))
    if large.isEmpty():
        return rows, None
    same = F.col(group) == F.col("_large")
    return rows.join(large, same, "left_anti"), rows.join(large, same, "left_semi")


def near_in_groups(points: DataFrame, radius=5.0, structure="structure_id") -> DataFrame:
    """All columns and `neighbors` of the points of small structures, each compared in one task.

    Points in the order of x meet those within `radius` along x only. A point without a finite coordinate has NULL.
    """

    def run(table: pa.Table) -> pa.Table:
        x, y, z = (pc.cast(table.column(c), pa.float64()).to_numpy().astype(float) for c in "xyz")
        finite = np.isfinite(x) & np.isfinite(y) & np.isfinite(z)
        order = np.flatnonzero(finite)
        order = order[np.argsort(x[order], kind="stable")]
        x, y, z = x[order], y[order], z[order]
        reach = radius + 1e-9 * (radius + np.abs(x).max(initial=0.0))
        got = np.zeros(table.num_rows, dtype=np.int64)
        for low in range(0, len(order), POINTS_AT_ONCE):
            part = slice(low, low + POINTS_AT_ONCE)
            near = slice(np.searchsorted(x, x[part][0] - reach), np.searchsorted(x, x[part][-1] + reach, "right"))
            distance = (x[part, None] - x[None, near]) ** 2 + (y[part, None] - y[None, near]) ** 2 + (z[part, None] - z[None, near]) ** 2
            got[order[part]] = np.count_nonzero(distance <= radius * radius, axis=1) - 1
        return table.append_column("neighbors", pa.array(got, mask=~finite))

    schema = StructType([*points.schema.fields, StructField("neighbors", LongType())])
    return points.groupBy(structure).applyInArrow(run, schema)


def count_within_radius(points, radius=5.0, structure="structure_id", key="pos") -> DataFrame:
    """Neighbours of every point within `radius`, per structure; points without a coordinate are left out.

    Structures of at most STRUCTURE_ROWS points are dealt once and compared in a task each, larger ones
    go through an octree.
    """
    known = points.select(structure, key, "x", "y", "z").filter(
        F.col(structure).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    small, large = by_size(known, structure)
    out = near_in_groups(small, radius, structure).filter(F.col("neighbors").isNotNull())
    if large is not None:
        out = out.unionByName(near_by_octree(large, radius, structure))
    return out.select(structure, key, "neighbors")


def near_by_octree(points: DataFrame, radius=5.0, structure="structure_id") -> DataFrame:
    """All columns and `neighbors` of points with coordinates, in structures of any size.

    Points sharing a coordinate collapse first. Space is a linear octree: cells of side `radius`, halved
    from level to level, with the number of points of each node. Pairs of nodes are settled from these
    numbers where the cubes lie wholly inside the radius or wholly beyond it; of the others those of few
    points are compared by points, and only the rest is split into children. So dense regions cost
    what lies near the surface of the sphere, not all their pairs. Levels are built only while such
    pairs exist.
    """
    spots = cut_lineage(points.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()).groupBy(
        F.col(structure).alias("s"), "x", "y", "z").agg(F.count(F.lit(1)).alias("k")))
    axes = ["i", "j", "l"]

    def at_level(level: int) -> DataFrame:
        return spots.select("s", "x", "y", "z", "k", *[c.alias(n) for c, n in zip(_node(radius, level), axes)])

    def nodes_at(level: int) -> DataFrame:
        return at_level(level).groupBy("s", *axes).agg(F.sum("k").alias("k"), F.count(F.lit(1)).alias("n"))

    def named(rows: DataFrame, mark: str) -> DataFrame:
        return rows.select(*[F.col(c).alias(f"{mark}{c}") for c in ("s", *axes, "k", "n")])

    def first_pairs(nodes: DataFrame) -> DataFrame:
        """Every node with itself and with the half of its neighbours that comes later."""
        steps = F.array(*[
            F.struct(*[F.lit(v).cast("bigint").alias(f"d{n}") for v, n in zip(step, axes)])
            for step in ((i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)) if step >= (0, 0, 0)])
        probes = named(nodes, "a_").select("*", F.inline(steps)).select(
            "*", *[(F.col(f"a_{n}") + F.col(f"d{n}")).alias(f"t{n}") for n in axes])
        right = named(nodes, "b_")
        return probes.join(right, (F.col("a_s") == F.col("b_s")) & (F.col("ti") == F.col("b_i")) & (F.col("tj") == F.col("b_j")) & (F.col("tl") == F.col("b_l"))).select(
            *[f"{m}{c}" for m in ("a_", "b_") for c in ("s", *axes, "k", "n")])

    def child_pairs(pairs: DataFrame, level: int) -> DataFrame:
        """The pairs of children of pairs of the level above, each pair of nodes once."""
        nodes = cut_lineage(nodes_at(level))
        up = [F.floor(F.col(n) / 2).cast("bigint").alias(f"u{n}") for n in axes]

        def below(mark: str) -> DataFrame:
            return nodes.select(*[F.col(c).alias(f"{mark}{c}") for c in ("s", *axes, "k", "n")], *[u.alias(f"{mark}u{n}") for u, n in zip(up, axes)])

        wanted = pairs.select("a_s", *[F.col(f"{m}{n}").alias(f"p{m}{n}") for m in ("a_", "b_") for n in axes])
        one = wanted.join(below("a_").withColumnRenamed("a_s", "s1"), (F.col("a_s") == F.col("s1")) & (F.col("pa_i") == F.col("a_ui")) & (F.col("pa_j") == F.col("a_uj")) & (F.col("pa_l") == F.col("a_ul")))
        two = one.join(below("b_"), (F.col("a_s") == F.col("b_s")) & (F.col("pb_i") == F.col("b_ui")) & (F.col("pb_j") == F.col("b_uj")) & (F.col("pb_l") == F.col("b_ul")))
        same = F.lit(True)
        for n in axes:
            same = same & (F.col(f"pa_{n}") == F.col(f"pb_{n}"))
        later = F.struct(*[F.col(f"a_{n}").alias(n) for n in axes]) <= F.struct(*[F.col(f"b_{n}").alias(n) for n in axes])
        return two.filter(~same | later).select(*[f"{m}{c}" for m in ("a_", "b_") for c in ("s", *axes, "k", "n")])

    def both_ends(rows: DataFrame, names: list[str]) -> DataFrame:
        """What a gives to b and b to a; a pair of one node or point gives once."""
        same = F.lit(True)
        for n in names:
            same = same & (F.col(f"a_{n}") == F.col(f"b_{n}"))
        to_a = F.struct(*[F.col(f"a_{n}").alias(n) for n in names], F.col("b_k").alias("got"))
        to_b = F.struct(*[F.col(f"b_{n}").alias(n) for n in names], F.col("a_k").alias("got"))
        return rows.select(F.col("a_s").alias("s"), F.inline(F.when(same, F.array(to_a)).otherwise(F.array(to_a, to_b))))

    counts = []
    pairs = first_pairs(cut_lineage(nodes_at(0)))
    for level in range(DEEPEST + 1):
        far = F.lit(0).cast("bigint")
        near = F.lit(0).cast("bigint")
        for n in axes:
            gap = F.abs(F.col(f"a_{n}") - F.col(f"b_{n}"))
            far, near = far + (gap + 1) * (gap + 1), near + F.greatest(gap - 1, F.lit(0)) * F.greatest(gap - 1, F.lit(0))
        reach = 1 << 2 * level
        kind = F.when(far < reach, "inside").when(near > reach, "beyond").when(
            (F.col("a_n") * F.col("b_n") <= NODE_PAIRS) | F.lit(level == DEEPEST), "points").otherwise("split")
        marked = cut_lineage(pairs.withColumn("kind", kind).filter("kind <> 'beyond'"))
        here = at_level(level)
        settled = both_ends(marked.filter("kind = 'inside'"), axes).groupBy("s", *axes).agg(F.sum("got").alias("got"))
        counts.append(here.join(settled, ["s", *axes]).select("s", "x", "y", "z", "got"))
        left, right = (here.select(*[F.col(c).alias(f"{m}{c}") for c in ("s", *axes, "x", "y", "z", "k")]) for m in ("a_", "b_"))
        few = marked.filter("kind = 'points'").select(*[f"{m}{n}" for m in ("a_", "b_") for n in ("s", *axes)])
        met = few.join(left, ["a_s", *[f"a_{n}" for n in axes]]).join(right, ["b_s", *[f"b_{n}" for n in axes]])
        apart = F.lit(False)
        for n in axes:
            apart = apart | (F.col(f"a_{n}") != F.col(f"b_{n}"))
        once = apart | (F.struct(*[F.col(f"a_{c}").alias(c) for c in "xyz"]) <= F.struct(*[F.col(f"b_{c}").alias(c) for c in "xyz"]))
        distance = sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) ** 2 for c in "xyz"), F.lit(0.0))
        counts.append(both_ends(met.filter(once & (distance <= radius * radius)), ["x", "y", "z"]))
        rest = marked.filter("kind = 'split'")
        if rest.isEmpty():
            break
        pairs = child_pairs(rest, level + 1)
    total = counts[0]
    for more in counts[1:]:
        total = total.unionByName(more)
    total = total.groupBy("s", "x", "y", "z").agg(F.sum("got").alias("n")).withColumnsRenamed({c: f"_{c}" for c in "sxyz"} | {"n": "_n"})
    return points.join(total, (F.col(structure) == F.col("_s")) & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")) & (F.col("z") == F.col("_z"))).select(
        *[points[c] for c in points.columns], (F.col("_n") - 1).alias("neighbors"))
