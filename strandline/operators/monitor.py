"""The monitor round: which files are new, changed or unrecorded, and what they probably are."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.paths import ancestors, basename, folder_of, guess_type, matches_any, stem, suffix
from strandline.plans import cut, top_per_project
from strandline.vocab import IGNORE_GLOBS, NAME_SIMILARITY

P = "project_id"


def visible_files(files: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """Files that are neither hidden nor ignored."""
    hidden = F.col("path").rlike(r"(^|/)\.")
    return files.where(~hidden & ~matches_any(F.col("path"), [*IGNORE_GLOBS, *ignore]))


def untracked(files: DataFrame, tracked: DataFrame, tracked_folders: DataFrame | None = None) -> DataFrame:
    """Files that are no recorded artifact and do not lie below a recorded folder.

    Folders are compared once per distinct folder, with each folder above it.
    """
    left = files.join(tracked.select(P, "path").distinct(), [P, "path"], "left_anti")
    if tracked_folders is None:
        return left
    places = left.select(P, folder_of(F.col("path")).alias("_folder")).distinct()
    covered = (places.withColumn("path", F.explode(ancestors(F.col("_folder"))))
               .join(tracked_folders.select(P, "path").distinct(), [P, "path"], "left_semi")
               .select(P, "_folder").distinct())
    return left.withColumn("_folder", folder_of(F.col("path"))).join(covered, [P, "_folder"], "left_anti").drop("_folder")


def new_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files whose size or time differs from what the last round remembers, with changed_since_seen."""
    before = seen.select(P, "path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"),
                         F.lit(True).alias("_seen")).dropDuplicates([P, "path"])
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime").eqNullSafe(F.col("_mtime"))
    return (files.join(before, [P, "path"], "left").where(F.col("_seen").isNull() | ~same)
            .withColumn("changed_since_seen", F.col("_seen").isNotNull()).drop("_size", "_mtime", "_seen"))


def name_similarity(a: str, b: str) -> Column:
    """Ratcliff/Obershelp ratio of two names (columns)."""
    # defined here, so that workers get the function itself and need not find this package
    def ratios(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(left, right)], dtype="float64")

    return F.pandas_udf(ratios, T.DoubleType())(a, b)


def _rare_letters(name: Column, share: float) -> Column:
    """The letters of a name that any name similar enough must share one of.

    A ratio of at least t needs t/(2-t) of the letters, repeats counted, in common. Two sets with so many
    common members share one among their first n - ceil(n*t/(2-t)) + 1 in any fixed order; late repeats of a
    letter, then unusual letters, come first here.
    """
    letters = F.split(name, "")
    numbered = F.transform(letters, lambda c, i: F.struct(
        (-F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda x: x == c))).alias("again"),
        (-F.abs(F.hash(c))).alias("order"), c.alias("letter")))
    n = F.length(name)
    needed = F.greatest(F.lit(1), n - F.ceil(n * share - 1e-9).cast("int") + 1)
    return F.transform(F.slice(F.array_sort(numbered), F.lit(1), needed),
                       lambda s: F.concat(s["letter"], s["again"].cast("string")))


def _shorter(hashed: bool, *names: Column) -> Column:
    """The distinct texts that one character less makes of the given ones (an array), or their hashes."""
    def without_one(name: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1)))
        return F.transform(places, lambda i: F.concat(F.substr(name, F.lit(1), i - 1), F.substr(name, i + 1)))

    out = F.array_distinct(F.flatten(F.concat(*[F.transform(n, without_one) for n in names])))
    return F.array_distinct(F.transform(out, lambda n: F.xxhash64(n))) if hashed else out


def near_names(names: DataFrame, known: DataFrame, place: list[str]) -> DataFrame:
    """(place, stem, known, node_id): pairs that become equal by taking at most one character out of either.

    A name meets others under the hashes of its shorter forms, so numbered names meet those that differ in one digit, not
    all of their folder. A shared hash of different texts only adds a pair.
    """
    def keyed(table: DataFrame, column: str) -> DataFrame:
        forms = F.concat(F.array(F.xxhash64(column)), _shorter(True, F.array(F.col(column))))
        return table.withColumn("form", F.explode(F.array_distinct(forms)))

    return (keyed(names, "stem").join(keyed(known, "known"), [*place, "form"]).where("stem <> known")
            .select(*place, "stem", "known", "node_id").distinct())


def extended_names(names: DataFrame, known: DataFrame, place: list[str]) -> DataFrame:
    """(place, stem, known, node_id): pairs where the known name has two characters more, in any places."""
    sizes = names.select(*place, (F.length("stem") + 2).alias("_size")).distinct()
    fits = known.withColumn("_size", F.length("known")).join(sizes, [*place, "_size"], "left_semi").drop("_size")
    forms = fits.withColumn("form", F.explode(_shorter(True, _shorter(False, F.array(F.col("known"))))))
    return (names.withColumn("form", F.xxhash64("stem")).join(forms, [*place, "form"])
            .select(*place, "stem", "known", "node_id").distinct())


def version_candidates(files: DataFrame, tracked: DataFrame, threshold: float = NAME_SIMILARITY) -> DataFrame:
    """(path, node_id, ratio): the recorded file of the same folder and extension whose name is closest.

    Closest first. The ratio of names of a and b characters is at most 1 - d / (a + b) when d characters have to go from
    both to make them equal. Equal names need no ratio; then come names that differ by one character on either side, then
    those with two more. What was not met has d >= 3, or d = 2 and a name two characters shorter, so a name with a better
    ratio than 1 - 3 / (2a + 3) and 1 - 2 / (2a - 2) is settled. Only the others meet every name that shares a letter
    without which the threshold cannot be reached. Ties go to the smallest id.
    """
    def described(table: DataFrame, *more: str) -> DataFrame:
        name = basename(F.col("path"))
        return table.select(P, "path", *more, folder_of(F.col("path")).alias("folder"),
                            F.lower(suffix(name)).alias("ext"), F.lower(stem(name)).alias("stem"))

    place = [P, "folder", "ext"]
    one = [*place, "stem"]
    # one row per distinct name: equal names in a folder have equal ratios
    names = described(files).select(*one).distinct()
    known, _ = cut(described(tracked, "node_id").groupBy(*place, F.col("stem").alias("known"))
                   .agg(F.min("node_id").alias("node_id")), "known-names")
    equal, _ = cut(names.join(known.withColumnRenamed("known", "stem"), one).select(*one, "node_id", F.lit(1.0).alias("ratio")),
                   "equal-names")
    rest, _ = cut(names.join(equal.select(*one), one, "left_anti"), "other-names")

    def scored(pairs: DataFrame) -> DataFrame:
        fit = pairs.withColumn("ratio", name_similarity("stem", "known")).where(F.col("ratio") >= threshold)
        return fit.select(*one, "node_id", "ratio")

    def best(found: DataFrame) -> DataFrame:
        return (found.groupBy(*one).agg(F.min(F.struct((-F.col("ratio")).alias("r"), "node_id")).alias("best"))
                .select(*one, F.col("best.node_id").alias("node_id"), (-F.col("best.r")).alias("ratio")))

    def open_names(found: DataFrame, *unmet: Column) -> DataFrame:
        """The names whose best ratio so far does not exceed what an unmet name can reach."""
        settled = best(found).where(F.col("ratio") > F.greatest(*unmet) + 1e-9).select(*one)
        return rest.join(settled, one, "left_anti")

    a = F.length("stem")
    shorter = F.when(a > 2, 1 - 1 / (a - 1)).otherwise(1.0)
    found, _ = cut(scored(near_names(rest, known, place)), "near-names")
    more, _ = cut(scored(extended_names(open_names(found, 1 - 2 / (2 * a + 2), shorter), known, place)), "near-names")
    found = found.unionByName(more)
    far, _ = cut(open_names(found, 1 - 3 / (2 * a + 3), shorter), "far-names")
    share = threshold / (2 - threshold)
    left = far.withColumn("letter", F.explode(F.array_distinct(_rare_letters(F.col("stem"), share))))
    right = (known.join(far.select(*place).distinct(), place, "left_semi")
             .withColumn("letter", F.explode(F.array_distinct(_rare_letters(F.col("known"), share)))))
    b = F.length("known")
    pairs = (left.join(right, [*place, "letter"]).where(2 * F.least(a, b) >= threshold * (a + b) - 1e-9)
             .select(*one, "known", "node_id").distinct())
    closest = best(found.unionByName(scored(pairs)))
    return described(files).join(equal.unionByName(closest), one).select(P, "path", "node_id", "ratio")


def nearest_node(files: DataFrame, tracked: DataFrame) -> DataFrame:
    """(path, node_id): a recorded file in the same folder or the closest folder above; ties go to the smallest id."""
    homes = tracked.groupBy(P, folder_of(F.col("path")).alias("above")).agg(F.min("node_id").alias("node_id"))
    places = files.select(P, folder_of(F.col("path")).alias("folder")).distinct()
    steps = F.array_union(ancestors(F.col("folder")), F.array(F.lit("")))
    found = (places.withColumn("above", F.explode(steps)).join(homes, [P, "above"])
             .groupBy(P, "folder").agg(F.max_by("node_id", F.length("above")).alias("node_id")))
    return (files.select(P, "path", folder_of(F.col("path")).alias("folder")).join(found, [P, "folder"])
            .select(P, "path", "node_id"))


def suggestions(new: DataFrame, tracked: DataFrame, nodes: DataFrame) -> DataFrame:
    """New files with their probable type, the artifact they update or lie next to, and its step."""
    version = version_candidates(new, tracked).select(P, "path", F.col("node_id").alias("version_of"))
    near = nearest_node(new, tracked).select(P, "path", F.col("node_id").alias("_near"))
    steps = nodes.select(P, F.col("node_id").alias("_anchor"), "step")
    joined = new.join(version, [P, "path"], "left").join(near, [P, "path"], "left")
    anchored = joined.withColumn("near", F.when(F.col("version_of").isNull(), F.col("_near"))).withColumn(
        "_anchor", F.coalesce("version_of", "near"))
    return (anchored.join(steps, [P, "_anchor"], "left").drop("_anchor", "_near")
            .withColumn("type", guess_type(F.col("path"))))


def baseline_folders(files: DataFrame, limit: int = 12) -> DataFrame:
    """The folders of each project with most unrecorded files, reported by a first round instead of the files."""
    counts = files.groupBy(P, folder_of(F.col("path")).alias("folder")).agg(F.count(F.lit(1)).alias("files"))
    return top_per_project(counts, [F.col("files").desc(), F.col("folder")], limit)


def monitor_round(disk: DataFrame, new: DataFrame, stale: DataFrame) -> DataFrame:
    """One line per project: how many artifacts changed, are missing or stale, and how many files are new."""
    def tally(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(P).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(name))

    parts = [tally(disk.where("modified"), "updated"), tally(new, "new"), tally(stale, "stale"),
             tally(disk.where("missing"), "missing")]
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    totals = [F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0)).alias(w)
              for w in ("updated", "new", "stale", "missing")]
    return counts.groupBy(P).agg(*totals)


def has_news(rounds: DataFrame) -> Column:
    return (rounds["updated"] > 0) | (rounds["new"] > 0) | (rounds["missing"] > 0)


def minutes_since_last(rounds: DataFrame, now: Column) -> DataFrame:
    last = rounds.groupBy(P).agg(F.max("ts").alias("last_round"))
    return last.select(P, ((F.unix_timestamp(now) - F.unix_timestamp("last_round")) / 60).alias("minutes"))


def open_suggestions(found: DataFrame, tracked: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """Earlier suggestions that are still open: not recorded and not ignored by now."""
    return visible_files(found.join(tracked.select(P, "path").distinct(), [P, "path"], "left_anti"), ignore)
