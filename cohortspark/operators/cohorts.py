"""Joins of survival and expression, shared patients, catalog consistency (JN1-JN4, OV1-OV7, CT1-CT6)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators.endpoints import family_of
from cohortspark.sources.shared import kept

#: Cohorts of a title above which it counts as frequent, and cohorts of a title in one list (no effect on results).
FREQUENT, BLOCK = 1000, 1024


def survival_problems(surv: DataFrame) -> DataFrame:
    """JN1: (dataset, problem, n): negative times, status outside 0/1, repeated samples."""
    bad = surv.select("dataset", F.explode(F.array(F.when(F.col("time") < 0, F.lit("negative time")), F.when(~F.col("status").isin(0, 1), F.lit("status not 0/1")))).alias("problem")).where("problem IS NOT NULL").groupBy("dataset", "problem").agg(F.count(F.lit(1)).alias("n"))
    twice = surv.groupBy("dataset", "sample_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).select("dataset", F.lit("repeated sample").alias("problem"), "n")
    return bad.unionByName(twice)


def validate(surv: DataFrame) -> None:
    """JN1: raises when there is any problem (at most 20 are named)."""
    bad = survival_problems(surv).orderBy("dataset", "problem").take(20)
    if bad:
        raise ValueError("; ".join(f"{r['dataset']}: {r['problem']} ({r['n']})" for r in bad))


def merge(surv: DataFrame, expr: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN1: survival joined with expression, and samples of either side and of both per dataset."""
    a = surv.select("dataset", "sample_id", F.lit(1).alias("s")).distinct()
    b = expr.select("dataset", "sample_id", F.lit(1).alias("e")).distinct()
    counts = a.join(b, ["dataset", "sample_id"], "full_outer").groupBy("dataset").agg(F.count("s").alias("survival"), F.count("e").alias("expression"), F.sum((F.col("s").isNotNull() & F.col("e").isNotNull()).cast("int")).alias("both"))
    return surv.join(expr, ["dataset", "sample_id"]), counts


def merged_cohort(surv: DataFrame, expr: DataFrame, genes: Sequence[str], clinical: DataFrame | None = None) -> DataFrame:
    """JN2: survival with the collapsed values of some genes, and clinical columns where there are any."""
    x = expr.where(F.col("gene").isin(*genes)).groupBy("dataset", "sample_id", "gene").agg(F.max("value").alias("value"))
    out = surv.join(x, ["dataset", "sample_id"])
    return out if clinical is None else out.join(clinical, ["dataset", "sample_id"], "left")


def marker_counts(surv: DataFrame, marker: DataFrame) -> DataFrame:
    """JN3: per dataset rows kept and rows lost for want of an endpoint or a marker."""
    j = surv.join(marker, ["dataset", "sample_id"], "left")
    no_end = F.col("time").isNull() | F.col("status").isNull()
    return j.groupBy("dataset").agg(F.sum((~no_end & F.col("value").isNotNull()).cast("int")).alias("kept"), F.sum(no_end.cast("int")).alias("no_endpoint"), F.sum((~no_end & F.col("value").isNull()).cast("int")).alias("no_marker"))


def complete_cases(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """JN4: rows with all columns filled and a time of 0 at least, and the number dropped per dataset."""
    ok = F.lit(True)
    for c in [*columns, "time", "status"]:
        ok = ok & F.col(c).isNotNull()
    ok = ok & F.coalesce(F.col("time") >= 0, F.lit(False))
    return df.where(ok), df.groupBy("dataset").agg(F.sum(ok.cast("int")).alias("used"), F.sum((~ok).cast("int")).alias("dropped"))


def shared_pairs(titles: DataFrame, least: int = 5, frequent: int = FREQUENT) -> DataFrame:
    """OV1: (a, b, shared) cohorts with at least so many titles in common. titles: accession, title; blank titles are none.

    Every cohort's titles stand from rare to frequent. Of two cohorts that share ``least`` titles, the first size - least + m
    of each share m. A cohort takes m = ``least``, all its titles, less one for each title of more than ``frequent`` cohorts, 1
    at least. Cohorts of a title are lists of numbers; tasks count the numbers that each cohort meets, and send on pairs
    that meet as often as the lesser m of the two. Where that is not all titles of both, whole lists are compared after.
    A title that very many cohorts use ("1", "2") makes pairs only of cohorts that have hardly any other.
    """
    t = kept(titles.select("accession", "title").where("trim(title) <> ''").distinct())
    several = t.df.groupBy("title").agg(F.count(F.lit(1)).alias("_cohorts")).where("_cohorts > 1")
    own = Window.partitionBy("accession")
    ranked = t.df.join(several, "title").withColumn("_place", F.row_number().over(own.orderBy("_cohorts", "title"))).withColumn("_size", F.count(F.lit(1)).over(own))
    wanted = F.greatest(F.lit(1), F.lit(least) - F.sum((F.col("_cohorts") > frequent).cast("int")).over(own))
    placed = kept(ranked.withColumn("_m", wanted.cast("int")).where(F.col("_size") >= least))
    t.remove()
    # a cohort's number tells its m: number % least + 1
    at = F.monotonically_increasing_id()
    names = kept(placed.df.groupBy("accession").agg(F.first("_m").alias("_m")).select("accession", "_m", at.alias("_at")))
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = names.df.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    numbers = kept(names.df.join(F.broadcast(starts), part == F.col("_part")).select("accession", ((F.col("_start") + row) * least + F.col("_m") - 1).cast("int").alias("number")))
    posts = placed.df.where(F.col("_place") <= F.col("_size") - least + F.col("_m")).join(numbers.df, "accession")
    chunk = F.pmod(F.xxhash64("number"), F.ceil(F.col("_cohorts") / F.lit(float(BLOCK)))).alias("chunk")
    lists = posts.groupBy("title", chunk).agg(F.sort_array(F.collect_list("number")).alias("ids"))
    both = lists.join(lists.select("title", F.col("chunk").alias("chunk_b"), F.col("ids").alias("others")), "title")
    each = both.select("chunk", "chunk_b", "others", F.posexplode("ids").alias("k", "a"))
    later = F.when(F.col("chunk") == F.col("chunk_b"), F.slice("others", F.col("k") + 2, F.size("others"))).otherwise(F.filter("others", lambda x: x > F.col("a")))
    met = each.select("a", later.alias("b")).where(F.size("b") > 0).repartition("a").sortWithinPartitions("a")
    found = kept(met.mapInArrow(_met(least), "a int, b int, shared long"))
    whole = (F.col("a") % least == least - 1) & (F.col("b") % least == least - 1)
    rows = placed.df.join(numbers.df, "accession").select("number", "title")
    rest = found.df.where(~whole).select("a", "b").join(rows.select(F.col("number").alias("a"), "title"), "a").join(rows.select(F.col("number").alias("b"), "title"), ["b", "title"])
    pairs = found.df.where(whole).unionByName(rest.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least))
    named = lambda c: numbers.df.select(F.col("number").alias(c), F.col("accession").alias(f"_{c}"))
    out = kept(pairs.join(named("a"), "a").join(named("b"), "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "shared"))
    for table in (placed, names, numbers, found):
        table.remove()
    return out.df


def _met(least: int):
    """Counts of the pairs in rows of a number and a list of greater ones, sorted by the number: those that meet often enough."""

    def run(batches):
        keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

        def put(k, n):
            a, b = k >> 32, k & 0xFFFFFFFF
            ok = n >= np.minimum(a % least, b % least) + 1
            return pa.RecordBatch.from_arrays([pa.array(a[ok].astype(np.int32)), pa.array(b[ok].astype(np.int32)), pa.array(n[ok])], ["a", "b", "shared"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ends = batch.column(1).offsets.to_numpy()
            b = batch.column(1).values.to_numpy()[ends[0] : ends[-1]]
            fresh, n = np.unique((np.repeat(batch.column(0).to_numpy().astype(np.int64), np.diff(ends)) << 32) | b, return_counts=True)
            # the last number may go on: its counts so far are carried
            keys, at = np.unique(np.concatenate([keys, fresh]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
            cut = int(np.searchsorted(keys, (keys[-1] >> 32) << 32))
            if cut:
                yield put(keys[:cut], counts[:cut])
                keys, counts = keys[cut:], counts[cut:]
        if len(keys):
            yield put(keys, counts)

    return run


def series_pairs(catalog: DataFrame) -> DataFrame:
    """OV2: cohorts of one base series on two platforms, with the smaller size."""
    c = catalog.select("base", "accession", "n")
    return c.alias("x").join(c.alias("y"), "base").where("x.accession < y.accession").select(F.col("x.accession").alias("a"), F.col("y.accession").alias("b"), F.least("x.n", "y.n").alias("shared"))


def register(parts: Sequence[tuple[str, DataFrame]], collisions: DataFrame) -> DataFrame:
    """OV3: pairs of several sources, one per unordered key by the order of sources; known collisions go."""
    allp = None
    for k, (basis, df) in enumerate(parts):
        p = df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared", F.lit(basis).alias("basis"), F.lit(k).alias("k"))
        allp = p if allp is None else allp.unionByName(p)
    w = Window.partitionBy("a", "b").orderBy("k", F.desc("shared"))
    bad = collisions.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return allp.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "k").join(bad, ["a", "b"], "left_anti")


def overlap_groups(pairs: DataFrame) -> DataFrame:
    """OV4: (accession, root) of the connected components of pairs (a, b); the root is the least accession.

    Labels fall to the least among the neighbours, then to that one's own label, until none changes; each round ends in a
    table in the shared folder, which the next one replaces.
    """
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = kept(pairs.select(ways.alias("x")).select("x.*").distinct())
    table = kept(both.df.groupBy(F.col("a").alias("accession")).agg(F.min("b").alias("m")).select("accession", F.least("accession", "m").alias("root")))
    while True:
        label = table.df.select("accession", "root")
        near = both.df.join(label.withColumnRenamed("accession", "b"), "b").groupBy(F.col("a").alias("accession")).agg(F.min("root").alias("near"))
        low = label.join(near, "accession").select("accession", F.least("root", "near").alias("low"), F.col("root").alias("old"))
        new = kept(low.join(label.select(F.col("accession").alias("low"), F.col("root").alias("next")), "low").select("accession", F.least("low", "next").alias("root"), "old"))
        table.remove()
        table = new
        if new.df.where("root <> old").isEmpty():
            both.remove()
            return new.df.select("accession", "root")


def group_labels(groups: DataFrame) -> DataFrame:
    """OV4: label "first(+k)" of every group."""
    g = groups.groupBy("root").agg((F.count(F.lit(1)) - 1).alias("k"))
    return groups.join(g, "root").select("accession", "root", F.concat("root", F.lit("(+"), F.col("k").cast("string"), F.lit(")")).alias("label"))


def pairs_inside(pairs: DataFrame, selected: DataFrame) -> DataFrame:
    """OV5: pairs with both cohorts selected."""
    s = selected.select("accession").distinct()
    return pairs.join(s.withColumnRenamed("accession", "a"), "a", "left_semi").join(s.withColumnRenamed("accession", "b"), "b", "left_semi")


def overlap_policy(selected: DataFrame, groups: DataFrame, pairs: DataFrame, mode: str = "dedupe") -> DataFrame:
    """OV6: what becomes of each selected cohort (accession, n) whose patients others share.

    ``dedupe`` keeps the largest selected cohort of each group (ties by accession, null sizes last); the rest name it, with
    the patients shared with it (null if the two are linked through others only) and the reason. ``warn`` keeps all, with
    the note; ``refuse`` raises when any pair is selected whole (at most 20 are named).
    """
    if mode not in ("warn", "refuse", "dedupe"):
        raise ValueError("mode is warn, refuse or dedupe")
    if mode == "refuse":
        bad = pairs_inside(pairs, selected).orderBy("a", "b").take(20)
        if bad:
            raise ValueError("selected cohorts share patients: " + ", ".join(f"{r['a']} and {r['b']} ({r['shared']})" for r in bad))
    g = selected.select("accession", "n").join(groups.select("accession", "root"), "accession", "left").withColumn("root", F.coalesce("root", "accession"))
    w = Window.partitionBy("root").orderBy(F.desc_nulls_last("n"), "accession")
    out = g.withColumn("r", F.row_number().over(w)).withColumn("_winner", F.first("accession").over(w)).withColumn("_most", F.first("n").over(w)).withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("root")))
    both = pairs.select(F.col("a").alias("_x"), F.col("b").alias("_y"), F.col("shared").alias("shared_patients"))
    out = out.join(both, (F.least("accession", "_winner") == F.col("_x")) & (F.greatest("accession", "_winner") == F.col("_y")), "left")
    size = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    loses = F.col("r") > 1
    why = F.concat(F.lit("shares patients with "), "_winner", F.lit(": "), size("_most"), F.lit(" samples against "), size("n"))
    out = out.select("accession", "n", "root", "members", (~loses).alias("kept"), F.when(loses, F.col("_winner")).alias("dropped_for"), F.when(loses, F.col("shared_patients")).alias("shared_patients"), F.when(loses, why).alias("reason"))
    if mode == "dedupe":
        return out
    return out.select("accession", "n", "root", "members", F.lit(True).alias("kept"), F.lit(None).cast("string").alias("dropped_for"), F.lit(None).cast("long").alias("shared_patients"), F.when(F.col("members") > 1, "other selected cohorts share its patients").alias("reason"))


def groups_hit_twice(selected: DataFrame, groups: DataFrame) -> DataFrame:
    """OV7: groups with several selected cohorts, and their note."""
    g = selected.join(groups, "accession").groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("accession")), ", ").alias("cohorts"))
    return g.where("n > 1").withColumn("note", F.concat(F.lit("shares patients: "), "cohorts"))


def _usable(surv: DataFrame) -> DataFrame:
    """Distinct samples whose time and status are both there, per token."""
    return surv.where("time IS NOT NULL AND status IS NOT NULL").groupBy("dataset", "token", "sample_id").agg(F.max("status").alias("status"))


def sizes(catalog: DataFrame, surv: DataFrame, expr: DataFrame, families: Sequence[str], guarded: str = "TCGA-") -> DataFrame:
    """CT1: per catalog row n_surv, n_expr, n_<family>, N and events of the primary endpoint, and a note.

    catalog: dataset, n (the old one), primary (a family), ep_<family> (token or null: then the first token by name of that
    family in the survival table). surv is long by token: dataset, sample_id, token, time, status. A sample counts for a family where it has expression and both time and status of the
    family's token. N is that of the primary family; null without expression or sample. Rows of guarded accessions have no
    expression table by design: n_expr stays null, the old N stays, and every survival row counts as expressed.
    """
    e = expr.select("dataset", "sample_id").distinct()
    n_expr = e.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_expr"))
    rows = surv.select("dataset", "sample_id").distinct().groupBy("dataset").agg(F.count(F.lit(1)).alias("n_surv"))
    tokens = catalog.select("dataset", "primary", F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.col(f"ep_{f.lower()}").alias("token")) for f in families])).alias("x")).select("dataset", "primary", "x.*")
    there_ = surv.select("dataset", "token", family_of(F.col("token")).alias("family")).where(F.col("family").isin(*families)).groupBy("dataset", "family").agg(F.min("token").alias("_first"))
    tokens = tokens.join(there_, ["dataset", "family"], "left").withColumn("token", F.coalesce("token", "_first")).drop("_first").where("token IS NOT NULL")
    free = F.col("dataset").startswith(guarded)
    used = _usable(surv).join(tokens, ["dataset", "token"]).join(e.withColumn("_e", F.lit(True)), ["dataset", "sample_id"], "left").where(free | F.col("_e"))
    lead = F.col("family") == F.col("primary")
    counts = [F.sum((F.col("family") == f).cast("int")).alias(f"n_{f.lower()}") for f in families]
    g = used.groupBy("dataset").agg(*counts, F.sum(lead.cast("int")).alias("_n"), F.sum(F.when(lead, (F.col("status") == 1).cast("int"))).alias("n_events"))
    out = catalog.select("dataset", F.col("n").alias("_old"), "primary").join(rows, "dataset", "left").join(n_expr, "dataset", "left").join(g, "dataset", "left")
    there = F.col("n_surv").isNotNull() & (free | F.col("n_expr").isNotNull()) & F.col("primary").isNotNull()
    note = F.when(F.col("n_surv").isNull(), "no survival table").when(~free & F.col("n_expr").isNull(), "no expression table").when(F.col("primary").isNull(), "no primary endpoint")
    fams = [F.when(there, F.coalesce(f"n_{f.lower()}", F.lit(0))).otherwise(0).alias(f"n_{f.lower()}") for f in families]
    n = F.when(free, F.col("_old")).when(there & (F.col("_n") > 0), F.col("_n"))
    return out.select("dataset", "n_surv", F.when(~free, F.col("n_expr")).alias("n_expr"), *fams, n.alias("n"), F.when(there, F.col("n_events")).alias("n_events"), note.alias("note"))


def size_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """CT2: old and new N, and what the change is."""
    j = old.select("dataset", F.col("n").alias("old_n")).join(new.select("dataset", F.col("n").alias("new_n")), "dataset", "full_outer")
    return j.withColumn("change", F.when(F.col("new_n").isNull(), "would become null").when(F.col("old_n").isNull(), "new").when(F.col("old_n") == F.col("new_n"), "same").when(F.col("old_n") < F.col("new_n"), "grows").otherwise("shrinks"))


def lost_samples(catalog: DataFrame, surv: DataFrame, expr: DataFrame, named: int = 8) -> DataFrame:
    """CT3: per catalog row (dataset, n, primary) the survival rows with a usable primary endpoint that have no expression.

    ``reason`` names the first ids, or says why nothing could be compared. The gate of small cohorts (N < 51) is >=30, of
    the others >50; below 30 the author decides. surv is long by token.
    """
    own = surv.join(catalog.select("dataset", F.col("primary").alias("token")), ["dataset", "token"])
    pair = own.select("dataset").distinct().withColumn("_pair", F.lit(True))
    table = surv.select("dataset").distinct().withColumn("_table", F.lit(True))
    e = expr.select("dataset", "sample_id").distinct()
    lost = _usable(own).select("dataset", "sample_id").distinct().join(e, ["dataset", "sample_id"], "left_anti")
    first = lost.withColumn("r", F.row_number().over(Window.partitionBy("dataset").orderBy("sample_id")))
    g = first.groupBy("dataset").agg(F.count(F.lit(1)).alias("_lost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= named, F.struct("r", F.col("sample_id").cast("string").alias("id"))))), lambda x: x["id"]), ", ").alias("_ids"))
    out = catalog.select("dataset", "n", "primary").join(table, "dataset", "left").join(pair, "dataset", "left").join(e.select("dataset").distinct().withColumn("_expr", F.lit(True)), "dataset", "left").join(g, "dataset", "left")
    dropped = F.when(F.col("_pair") & F.col("_expr"), F.coalesce("_lost", F.lit(0)))
    why = (
        F.when(F.col("_table").isNull(), "no survival table").when(F.col("_pair").isNull(), F.concat(F.lit("primary token "), F.coalesce("primary", F.lit("NA")), F.lit(" has no status and time"))).when(F.col("_expr").isNull(), "no expression table")
        .when(dropped == 0, "none").otherwise(F.concat(dropped.cast("string"), F.lit(" without expression: "), "_ids"))
    )
    small = F.coalesce(F.col("n") < 51, F.lit(False))
    return out.select("dataset", "n", dropped.alias("dropped"), why.alias("reason"), F.when(small, ">=30").otherwise(">50").alias("gate"), F.when(F.coalesce(F.col("n") < 30, F.lit(False)), "author-decision").otherwise("gate").alias("decision"))


def work_plan(wanted: DataFrame, in_db: DataFrame, local: DataFrame, excluded: DataFrame) -> DataFrame:
    """CT4: presence flags and status of every wanted cohort."""
    mark = lambda d, n: d.select("accession", F.lit(True).alias(n)).distinct()
    j = wanted.join(mark(in_db, "db"), "accession", "left").join(mark(local, "local"), "accession", "left").join(mark(excluded, "out"), "accession", "left").fillna(False, ["db", "local", "out"])
    return j.withColumn("plan", F.when(F.col("out"), "EXCLUDED").when(F.col("db"), "DONE-DB").when(F.col("local"), "DONE-LOCAL").otherwise("TODO"))


#: Pooling classes of the semantics table.
POOLING_CLASSES = ("Exact-equivalent", "Clinically-related", "Not-poolable", "Unknown", "Absent")


def consistency(catalog: DataFrame, surv: DataFrame, expr: DataFrame, grid: DataFrame, families: Sequence[str], platforms: DataFrame, guarded: str = "TCGA-", named: int = 10) -> DataFrame:
    """CT5: (level, check, n, detail): what is broken in the catalog, its tables and the semantics grid; detail names the first.

    catalog: dataset, platform, survival_types, primary, ep_<family>, n, n_expr, n_surv, n_events, n_<family>. surv is long
    by token; grid: dataset, family, pooling_class; platforms: platform (tables that are there). Guarded accessions have no
    tables of their own. Counts are recomputed by ``sizes`` (a row per cohort, kept as a table, as several checks read
    them) and compared one by one. What the checks list is kept as a table too.
    """
    acc = catalog.select("dataset")
    own = catalog.where(~F.col("dataset").startswith(guarded))
    eps = [F.col(f"ep_{f.lower()}") for f in families]
    noted = F.coalesce(F.trim("survival_types") != "", F.lit(False))
    there = lambda d: d.select("dataset").distinct()
    said = F.concat("dataset", F.lit(" (survival types "), F.coalesce("survival_types", F.lit("NA")), F.lit(")"))
    now = kept(sizes(catalog, surv, expr, families, guarded)).df
    counted = ["n", "n_events", "n_surv", "n_expr", *(f"n_{f.lower()}" for f in families)]
    pairs = own.select("dataset", *[F.col(c).cast("long").alias(f"_{c}") for c in counted]).join(now, "dataset")
    wrong = pairs.select("dataset", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{c}").alias("said"), F.col(c).cast("long").alias("found")) for c in counted])).alias("x")).select("dataset", "x.*").where("said IS NOT NULL AND NOT (said <=> found)")
    full = catalog.select("dataset", F.explode(F.array(*map(F.lit, families))).alias("family")).distinct()
    cell = F.concat("dataset", F.lit("/"), "family")
    used = _usable(surv)
    name = F.col("dataset")
    checks = [
        ("error", "repeated accession", catalog.groupBy("dataset").count().where("count > 1").select("dataset"), name),
        ("error", "dash before the platform in an accession", catalog.where(F.col("dataset").contains("-GPL")), name),
        ("error", "endpoint columns empty though annotated or with a survival table", catalog.join(there(surv).withColumn("_s", F.lit(True)), "dataset", "left").where(F.coalesce(*eps, "primary").isNull() & (noted | F.col("_s").isNotNull())), said),
        ("error", "annotated without expression table", own.where(noted).join(there(expr), "dataset", "left_anti"), name),
        ("error", "annotated without survival table", own.where(noted).join(there(surv), "dataset", "left_anti"), name),
        ("error", "expression table without platform table", own.join(there(expr), "dataset", "left_semi").join(platforms.select("platform").distinct(), "platform", "left_anti"), F.concat("dataset", F.lit(" (platform "), F.coalesce("platform", F.lit("NA")), F.lit(")"))),
        ("warn", "table without catalog row", there(expr).union(there(surv)).distinct().join(acc, "dataset", "left_anti"), name),
        ("error", "status not 0/1", surv.where("status NOT IN (0, 1)").select("dataset", "token").distinct(), F.concat("dataset", F.lit("."), "token")),
        ("error", "count differs from the tables", wrong, F.concat_ws(" ", "dataset", "column", F.concat(F.col("said").cast("string"), F.lit("!="), F.coalesce(F.col("found").cast("string"), F.lit("NA"))))),
        ("error", "N above its tables", own.join(now.select("dataset", F.col("n_expr").alias("_e"), F.col("n_surv").alias("_v")), "dataset").where("n > _e OR n > _v"), name),
        ("error", "no sample in both tables", there(own.join(there(surv), "dataset", "left_semi").join(there(expr), "dataset", "left_semi")).join(there(surv.join(expr.select("dataset", "sample_id").distinct(), ["dataset", "sample_id"], "left_semi")), "dataset", "left_anti"), name),
        ("warn", "status column empty", surv.groupBy("dataset", "token").agg(F.count("status").alias("_n")).where("_n = 0"), F.concat("dataset", F.lit("."), "token")),
        ("warn", "primary endpoint without events", own.where("n IS NOT NULL AND n_events = 0"), name),
        ("info", "expression but no N", own.join(there(expr), "dataset", "left_semi").where("n IS NULL"), name),
        ("error", "token without time and status", tokens_of(own, families).join(there(surv), "dataset", "left_semi").join(used.select("dataset", "token").distinct(), ["dataset", "token"], "left_anti"), F.concat("dataset", F.lit(" "), "token")),
        ("error", "count of a family that is not registered", own.select("dataset", F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.when(F.col(f"ep_{f.lower()}").isNull(), F.col(f"n_{f.lower()}")).alias("k")) for f in families])).alias("x")).select("dataset", "x.*").where("k <> 0"), cell),
        ("error", "cell missing in the grid", full.join(grid, ["dataset", "family"], "left_anti"), cell),
        ("error", "grid cell without cohort", grid.join(full, ["dataset", "family"], "left_anti"), cell),
        ("error", "repeated grid cell", grid.groupBy("dataset", "family").count().where("count > 1"), cell),
        ("error", "pooling class blank or unknown", grid.where(~F.coalesce(F.trim("pooling_class"), F.lit("")).isin(*POOLING_CLASSES)), cell),
        ("info", "no endpoint annotation", catalog.where(~noted), name),
    ]
    parts = [rows.select(F.lit(at).alias("at"), what.alias("x")) for at, (_, _, rows, what) in enumerate(checks)]
    while len(parts) > 1:  # in pairs: a plan that grows one by one is analysed anew each time
        parts = [a.unionByName(b) for a, b in zip(parts[::2], parts[1::2], strict=False)] + parts[len(parts) // 2 * 2 :]
    spelled = first_of(kept(parts[0]).df, ["at"], named).select("at", "n", F.array_join("first", ", ").alias("detail"))
    names = catalog.sparkSession.createDataFrame([(at, level, check) for at, (level, check, _, _) in enumerate(checks)], "at int, level string, check string")
    return names.join(spelled, "at", "left").select("level", "check", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("detail", F.lit("")).alias("detail"))


def first_of(found: DataFrame, keys: Sequence[str], named: int) -> DataFrame:
    """Per key: n (rows of found), different (distinct x that are not null) and the first of those, in order, at most ``named``.

    Counted per x first, and only the first of each partition are sent on, so no task holds all names of a key. Both parts
    read the same counts (nulls come last and leave after ranking), so what was found is computed once.
    """
    each = found.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("k"))
    ranked = each.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("x")))).where(F.col("r") <= named)
    top = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("r", "x", "k"))).alias("top"))
    first = top.select(*keys, F.transform(F.filter("top", lambda t: t["x"].isNotNull()), lambda t: t["x"]).alias("first"))
    return each.groupBy(*keys).agg(F.sum("k").alias("n"), F.count("x").alias("different")).join(first, list(keys), "left")


def tokens_of(catalog: DataFrame, families: Sequence[str]) -> DataFrame:
    """(dataset, family, token) of the registered endpoints."""
    return catalog.select("dataset", F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.col(f"ep_{f.lower()}").alias("token")) for f in families])).alias("x")).select("dataset", "x.*").where("token IS NOT NULL")


def sweep(catalog: DataFrame, surv: DataFrame, expr: DataFrame, fits: DataFrame) -> DataFrame:
    """CT6: what a run over one cohort after the other would give: type, status, samples, genes, events, detail.

    expr has the rows of the genes asked for; fits: dataset, gene, reason of the univariable models. SKIP: no table.
    FAIL: a step without result (no gene, no shared sample). WARN: no model. Survival alone is OK.
    """
    e = expr.groupBy("dataset").agg(F.countDistinct("sample_id").alias("samples"), F.countDistinct("gene").alias("genes"))
    s = surv.groupBy("dataset").agg(F.countDistinct("sample_id").alias("_s"))
    both = surv.join(expr.select("dataset", "sample_id").distinct(), ["dataset", "sample_id"], "left_semi")
    m = both.groupBy("dataset").agg(F.count(F.when(F.col("time").isNotNull() & F.col("status").isNotNull(), 1)).alias("_m"), F.coalesce(F.sum((F.col("status") == 1).cast("int")), F.lit(0)).alias("events"))
    f = fits.groupBy("dataset").agg(F.sum(F.col("reason").isNull().cast("int")).alias("_f"))
    j = catalog.select("dataset").distinct().join(e, "dataset", "left").join(s, "dataset", "left").join(m, "dataset", "left").join(f, "dataset", "left")
    has_e, has_s = F.col("samples").isNotNull(), F.col("_s").isNotNull()
    kind = F.when(has_e & has_s, "full").when(has_e, "expr-only").when(has_s, "surv-only").otherwise("not-in-db")
    models = F.coalesce("_f", F.lit(0))
    status = F.when(~has_e & ~has_s, "SKIP").when(~has_e, "OK").when(~has_s | F.col("_m").isNull() | (F.col("_m") == 0), "FAIL").when(models > 0, "OK").otherwise("WARN")
    detail = (
        F.when(~has_e & ~has_s, "no table").when(~has_e, "survival only").when(~has_s, "no survival table to merge").when(F.col("_m").isNull(), "no sample in both tables").when(F.col("_m") == 0, "no endpoint in the merged rows")
        .otherwise(F.concat(F.lit("cox rows="), models.cast("string"), F.when(F.col("events") == 0, " [0 events]").otherwise("")))
    )
    return j.select("dataset", kind.alias("type"), status.alias("status"), F.coalesce(F.col("samples"), F.col("_s")).alias("samples"), "genes", F.when(has_e & has_s, F.col("events")).alias("events"), detail.alias("detail"))
