"""What would be done to files: plans and their checks as tables. Nothing here touches a file."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filegrove.functions import paths
from filegrove.functions.paths import path_order
from filegrove.operators.ranges import carried, ranked
from filegrove.operators.tables import stored

CHANGED = "The source changed since the scan."
#: Which tools may change files in bulk, and which may rename (fixed values).
MUTATING = ("EmptyFiles", "EmptyFolders", "BigFiles", "TemporaryFiles", "InvalidLinks", "BrokenFiles", "SimilarImages", "SimilarVideos", "MusicDuplicates")
RENAMING = ("EmptyFiles", "EmptyFolders", "BigFiles", "TemporaryFiles", "InvalidLinks", "SimilarImages", "SimilarVideos", "MusicDuplicates", "BadExtensions", "BadNames")
#: Attributes that both files of a link must share, and that neither may have.
EQUAL_ATTRIBUTES = paths.READ_ONLY | paths.HIDDEN | paths.SYSTEM
MOST_LINKS = 1024


def kind_of(attributes: Column) -> Column:
    directory, link = paths.has(attributes, paths.DIRECTORY), paths.has(attributes, paths.REPARSE_POINT)
    return F.when(directory & link, "DirectoryLink").when(link, "FileLink").when(directory, "Directory").otherwise("File")


def authority(sessions: DataFrame) -> DataFrame:
    """sessions (tool) with may_change and may_rename: what a result's tool allows in bulk."""
    return sessions.withColumns({"may_change": F.col("tool").isin(*MUTATING), "may_rename": F.col("tool").isin(*RENAMING)})


def revalidated(targets: DataFrame, inventory: DataFrame) -> DataFrame:
    """targets (full_path, kind, size_bytes, modified_ticks or null, survivors: array of paths or null) with failure: null
    where the action may go on. inventory: the files and folders as they are now, with physical_child_count of folders.

    A survivor that is gone or no longer an unchanged file fails the target as well; survivors are looked up by a join."""
    now = inventory.select(F.upper("full_path").alias("_u"), kind_of(F.col("attributes")).alias("_kind"), F.col("size_bytes").alias("_size"), F.col("modified_ticks").alias("_ticks"), F.col("physical_child_count").alias("_children"))
    rows = targets.withColumn("_u", F.upper("full_path"))
    kept = rows.select("_u", F.explode("survivors").alias("s")).select(F.col("_u").alias("_target"), F.upper("s.path").alias("_u"), F.col("s.size_bytes").alias("_ws"), F.col("s.modified_ticks").alias("_wt")).join(now, "_u", "left")
    sound = (F.col("_kind") == "File") & (F.col("_size") == F.col("_ws")) & (F.col("_ticks") == F.col("_wt"))
    bad = kept.where(~F.coalesce(sound, F.lit(False))).select(F.col("_target").alias("_u")).distinct().withColumn("_bad", F.lit(True))
    joined = rows.join(now, "_u", "left").join(bad, "_u", "left")
    stale = (F.col("kind") == "File") & ((F.col("_size") != F.col("size_bytes")) | F.coalesce(F.col("_ticks") != F.col("modified_ticks"), F.lit(False)))
    failure = F.when(F.col("_bad"), CHANGED).when(F.col("_kind").isNull(), "The source no longer exists.").when(F.col("_kind") != F.col("kind"), CHANGED).when(stale, CHANGED)
    failure = failure.when((F.col("kind") == "Directory") & (F.col("_children") > 0), "The directory is no longer empty.")
    return joined.withColumn("failure", failure).select(*targets.columns, "failure")


def action_summary(outcomes: DataFrame) -> DataFrame:
    """One row of outcomes (size_bytes, failure): done, bytes, failed."""
    ok = F.col("failure").isNull()
    return outcomes.agg(F.count_if(ok).alias("n_done"), F.coalesce(F.sum(F.when(ok, F.col("size_bytes"))), F.lit(0)).alias("bytes_done"), F.count_if(~ok).alias("n_failed"))


@dataclass(frozen=True)
class Naming:
    """How a plan names outputs: stem, middle, " (n)" from the second try on, and an ending (None: the name's own)."""

    middle: str = ""
    ending: str | None = None

    def first(self, name: Column) -> Column:
        """The first try as a column."""
        return F.concat(*self.columns(name))

    def columns(self, name: Column) -> tuple[Column, Column]:
        """What stands before and behind the number, as columns."""
        own = F.regexp_extract(name, r"(\.[^.]*)$", 1) if self.ending is None else F.lit(self.ending)
        return F.concat(paths.stem(name), F.lit(self.middle)), own

    def parts(self, name: str) -> tuple[str, str]:
        """What stands before and behind the number."""
        dot = name.rfind(".")
        stem, own = (name, "") if dot < 0 else (name[:dot], name[dot:])
        return stem + self.middle, own if self.ending is None else self.ending

    def base(self, name: Column, made: bool = False) -> Column:
        """What a source and all names that it may be given have in common: the source's stem without numbers, in capitals. made:
        the name is one that this naming may have given."""
        plain = F.regexp_replace(F.upper(paths.stem(name)), NUMBERS, "")
        middle = self.middle.upper()
        if not made or not middle:
            return plain
        return F.regexp_replace(F.when(plain.endswith(middle), F.substring(plain, F.lit(1), F.length(plain) - len(middle))).otherwise(plain), NUMBERS, "")


NUMBERS = r"( \([0-9]+\))+$"
#: stem (2).ext; stem.optimized.mp4, stem.optimized (2).mp4; stem.clean.ext, stem.clean (2).ext
MOVED, OPTIMIZED, CLEANED = Naming(), Naming(".optimized", ".mp4"), Naming(".clean")


#: Rows and names in use of a folder that have one base and are settled in one task; more are settled by ranges.
SETTLED = 10_000


def free_names(rows: DataFrame, taken: DataFrame, folder: str, naming: Naming) -> DataFrame:
    """rows with new_name: for each, in path order within its folder, the first try of naming that is neither taken (folder,
    name; without regard to case) nor given to an earlier row.

    Names can meet only if they have the folder and the base in common ("a.txt" and "a (2).txt" have). A row that is alone
    with its base gets its first try; up to SETTLED rows and names of one folder and base are settled in a task, in linear
    time; beyond, no task sees all of them (see _given)."""
    keyed = rows.select("full_path", "file_name", F.upper(F.col(folder)).alias("_folder"), naming.base(F.col("file_name")).alias("_base"))
    used = taken.select(F.upper(F.col("folder")).alias("_folder"), naming.base(F.col("name"), True).alias("_base"), F.col("name").alias("file_name"))
    counts = keyed.select("_folder", "_base", F.lit(1).alias("_rows")).unionByName(used.select("_folder", "_base", F.lit(0).alias("_rows")))
    contested = stored(counts.groupBy("_folder", "_base").agg(F.sum("_rows").alias("_rows"), F.count("*").alias("_all")).where("_rows > 0 AND _all > 1").select("_folder", "_base", (F.col("_all") > SETTLED).alias("_many")), "contested")
    alone = keyed.join(contested, ["_folder", "_base"], "left_anti").select("full_path", naming.first(F.col("file_name")).alias("new_name"))
    both = keyed.withColumn("_order", F.upper("full_path")).unionByName(used, allowMissingColumns=True).join(contested, ["_folder", "_base"])

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        given = set(group.loc[group["full_path"].isna(), "file_name"].str.upper())
        tries: dict[tuple[str, str], int] = {}
        out = []
        for path, name in group.dropna(subset=["full_path"]).sort_values(["_order", "full_path"])[["full_path", "file_name"]].itertuples(index=False):
            head, tail = naming.parts(name)
            key = head.upper(), tail.upper()
            n = tries.get(key, 1)
            while (new := f"{head}{f' ({n})' if n > 1 else ''}{tail}").upper() in given:
                n += 1
            given.add(new.upper())
            tries[key] = n + 1
            out.append((path, new))
        return pd.DataFrame(out, columns=["full_path", "new_name"])

    few = both.where("NOT _many").select("_folder", "_base", "full_path", "file_name", "_order")
    settled = few.groupBy("_folder", "_base").applyInPandas(settle, "full_path string, new_name string")
    if not contested.where("_many").isEmpty():
        settled = settled.unionByName(_given(both.where("_many"), naming))
    return rows.join(alone.unionByName(settled), "full_path")


_NUMBER = r" \(([2-9]|[1-9][0-9]{1,8})\)"


def _given(both: DataFrame, naming: Naming) -> DataFrame:
    """(full_path, new_name) of rows (full_path, file_name, _folder, _order) among names in use (full_path null).

    Rows with one head and tail are a family, which asks for the numbers 1, 2, 3 ... of its name in path order. A family
    "a (5).txt" asks for the number 5 of the family "a.txt" as its number 1, once, when its first row comes. From then on that
    number isn't to be had for the others, whoever got it; so a number has a deadline, and a family depends only on the one
    it is named after. Families are settled by how many numbers their heads end with, each such step in sorted ranges: the
    n-th row of a family gets the n-th number that isn't out of reach."""
    head, tail = naming.columns(F.col("file_name"))
    rows = both.where("full_path IS NOT NULL").select("full_path", "_order", "_folder", head.alias("head"), tail.alias("tail"))
    rows = rows.withColumns({"_head": F.upper("head"), "_tail": F.upper("tail")})
    family = ["_folder", "_head", "_tail"]
    rows = stored(ranked(rows, family, [F.col("_order"), F.col("full_path")], "n"), "claims")
    named = F.regexp_extract("_head", _NUMBER + "$", 1)
    families = rows.where("n = 1").select(*family, F.col("_order").alias("first"), F.col("full_path").alias("first_path"), named.try_cast("int").alias("as"), F.regexp_replace("_head", _NUMBER + "$", "").alias("after"))
    families = stored(families.withColumn("depth", F.size(F.regexp_extract_all(F.regexp_extract("_head", f"(?:{_NUMBER})+$", 0), F.lit(_NUMBER), F.lit(1)))), "families")
    # numbers in use: each name may be the first of a family, or a later one wherever a number stands in it
    names = both.where("full_path IS NULL").select("_folder", F.upper("file_name").alias("name")).distinct()
    first = names.join(families.select(*family, F.concat("_head", "_tail").alias("name")), ["_folder", "name"]).select(*family, F.lit(1).alias("number"))
    cuts = F.explode(F.expr("transform(sequence(1, cast((length(name) - length(replace(name, ' (', ''))) / 2 as int)), i -> substring_index(name, ' (', i))"))
    later = names.where(F.col("name").contains(" (")).select("_folder", "name", cuts.alias("before")).withColumn("rest", F.expr("substring(name, length(before) + 1)"))
    later = later.select("_folder", F.col("before").alias("_head"), F.regexp_extract("rest", f"^{_NUMBER}", 1).alias("k"), F.regexp_replace("rest", f"^{_NUMBER}", "").alias("_tail")).where("k <> ''")
    later = later.join(families.select(*family), family).select(*family, F.col("k").try_cast("int").alias("number"))
    used = stored(first.unionByName(later).distinct(), "numbers-in-use")
    # what a family named after another one asks of it, and when
    parents = families.select("_folder", F.col("_head").alias("after"), "_tail")
    asked = families.where("as IS NOT NULL").join(parents, ["_folder", "after", "_tail"]).select("_folder", F.col("after").alias("_head"), "_tail", F.col("as").alias("number"), F.col("first").alias("_order"), F.col("first_path").alias("full_path"), F.col("_head").alias("by"))
    asked = stored(asked.join(used, [*family, "number"], "left_anti"), "asked")
    out = []
    for depth in range((families.agg(F.max("depth")).first()[0] or 0) + 1):
        level = families.where(F.col("depth") == depth).select(*family)
        claims, closed = rows.join(level, family), used.join(level, family)
        if out:  # the family above may have given the first name away
            gone = asked.join(out[-1].select(*family, "number"), [*family, "number"]).select("_folder", F.col("by").alias("_head"), "_tail", F.lit(1).alias("number"))
            closed = stored(closed.unionByName(gone.join(level, family)).distinct(), "closed")
        late = _too_late(claims, closed, asked.join(level, family), family)
        out.append(stored(_nth_open(claims, closed.unionByName(late), family), "given"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.select("full_path", F.concat("head", F.when(F.col("number") > 1, F.concat(F.lit(" ("), F.col("number").cast("string"), F.lit(")"))).otherwise(""), "tail").alias("new_name"))


def _too_late(claims: DataFrame, closed: DataFrame, asked: DataFrame, family: list[str]) -> DataFrame:
    """(family, number): numbers that a family's rows don't reach before their deadlines. In the order of numbers, one is
    reached if fewer of those before it were than rows come in time; that is settled family by family, in linear time
    over the numbers that other families ask for."""
    if asked.isEmpty():
        return asked.select(*family, "number")
    times = claims.select(*family, "_order", "full_path", "n").unionByName(asked.select(*family, "_order", "full_path", "number"), allowMissingColumns=True)
    timed = carried(times, family, [F.col("_order"), F.col("full_path"), F.coalesce("number", F.lit(0))], F.col("n"), "in_time").where("number IS NOT NULL")
    kinds = timed.select(*family, "number", F.coalesce("in_time", F.lit(0)).alias("in_time")).unionByName(closed.select(*family, "number"), allowMissingColumns=True)
    placed = ranked(kinds, family, [F.col("number")], "place").where("in_time IS NOT NULL")  # place - 1 numbers before it are closed or asked for

    def reach(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("number")
        reached, late = 0, []
        for number, in_time, place in group[["number", "in_time", "place"]].itertuples(index=False):
            open_ = number - place  # numbers before it that anyone may have
            if reached < in_time - open_:
                reached += 1
            else:
                late.append(number)
        return group[group["number"].isin(late)][[*family, "number"]]

    return placed.select(*family, "number", "in_time", "place").groupBy(*family).applyInPandas(reach, "_folder string, _head string, _tail string, number int")


def _nth_open(claims: DataFrame, closed: DataFrame, family: list[str]) -> DataFrame:
    """claims with number: the n-th number of the family from 1 that isn't closed. Before the j-th closed number k there are k - j
    open ones, so n + j is the n-th one's number for the last j with k - j < n."""
    marks = ranked(closed.select(*family, "number"), family, [F.col("number")], "j").select(*family, (F.col("number") - F.col("j")).alias("at"), "j")
    rows = claims.withColumn("at", F.col("n") - 1).unionByName(marks, allowMissingColumns=True)
    counted = carried(rows, family, [F.col("at"), F.coalesce("j", F.lit((1 << 62)))], F.col("j"), "before").where("n IS NOT NULL")
    return counted.withColumn("number", (F.col("n") + F.coalesce("before", F.lit(0))).cast("int")).drop("at", "j", "before")


def move_plan(targets: DataFrame, destination_names: DataFrame, destination: str, collision: str = "KeepBoth") -> DataFrame:
    """targets (full_path, file_name) with new_name and action for a move into one folder (names in use: column name).

    A name is in the way if it is in use or an earlier target by path has it. Skip leaves such targets, KeepBoth numbers
    them from 2, Cancel stops all as soon as one is in the way."""
    if collision not in ("Skip", "KeepBoth", "Cancel"):
        raise ValueError(f"no collision behaviour {collision!r}")
    named = free_names(targets.withColumn("_to", F.lit(destination)), destination_names.select(F.lit(destination).alias("folder"), "name"), "_to", MOVED).drop("_to")
    clash = F.upper("new_name") != F.upper("file_name")
    if collision == "KeepBoth":
        return named.withColumn("action", F.lit("move"))
    if collision == "Skip":
        return named.withColumn("action", F.when(clash, "skip").otherwise("move"))
    any_clash = named.agg(F.coalesce(F.max(clash), F.lit(False)).alias("_any"))
    return named.crossJoin(any_clash).withColumn("action", F.when(F.col("_any"), "cancel").otherwise("move")).drop("_any")  # one row


def clean_plan(sources: DataFrame, siblings: DataFrame) -> DataFrame:
    """sources (full_path, file_name, directory_path) with output_path for copies without metadata, beside them; names in use:
    siblings (folder, name)."""
    named = free_names(sources, siblings, "directory_path", CLEANED)
    return named.withColumn("output_path", F.concat("directory_path", F.lit(paths.SEPARATOR), "new_name")).drop("new_name")


def link_plan(members: DataFrame, survivors: DataFrame, by: list[str] = ("digest", "size_bytes")) -> tuple[DataFrame, DataFrame]:
    """(pairs, faults) of a selection (members with selected) and the survivors that a user named (by, survivor_path).

    pairs: survivor_path and duplicate_path for each selected file of a group whose survivor is one of its files that isn't
    selected. faults: groups with a selection but no such survivor, or more than one."""
    acted = members.groupBy(*by).agg(F.max(F.col("selected").cast("int")).alias("_any")).where("_any = 1").select(*by)
    named = survivors.select(*by, F.col("survivor_path").alias("full_path")).distinct()
    free = members.where("NOT selected").join(named, [*by, "full_path"]).groupBy(*by).agg(F.min("full_path").alias("survivor_path"), F.count("*").alias("_n"))
    named = named.groupBy(*by).agg(F.count("*").alias("_named"))
    judged = acted.join(free, list(by), "left").join(named, list(by), "left")
    sound = F.coalesce((F.col("_n") == 1) & (F.col("_named") == 1), F.lit(False))
    pairs = members.where("selected").join(judged.where(sound).select(*by, "survivor_path"), list(by)).select("survivor_path", F.col("full_path").alias("duplicate_path"))
    return pairs, judged.where(~sound).select(*by)


def rename_checks(candidates: DataFrame, siblings: DataFrame, recommended_only: bool = False) -> DataFrame:
    """candidates (full_path, new_name, suggestion) with message: null where the rename may go on; the first that holds of:
    not current (no current row), no parent, invalid name, same name, not the recommended one, name in use by a sibling
    (full_path of all entries)."""
    upper = lambda c: F.upper(F.col(c))
    now = siblings.select(F.upper(paths.parent(F.col("full_path"))).alias("_p"), F.upper(paths.file_name(F.col("full_path"))).alias("_n"), F.upper("full_path").alias("_self")).distinct()
    rows = candidates.withColumns({"_p": F.upper(paths.parent(F.col("full_path"))), "_n": upper("new_name"), "_u": upper("full_path")})
    current = now.select(F.col("_self").alias("_u")).distinct().withColumn("_current", F.lit(True))
    taken = rows.select("full_path", "_p", "_n", "_u").join(now, ["_p", "_n"]).where("_self <> _u").select("full_path").distinct().withColumn("_taken", F.lit(True))
    joined = rows.join(current, "_u", "left").join(taken, "full_path", "left")
    invalid = ~paths.valid_leaf(F.col("new_name")) | F.col("new_name").startswith(".") | F.col("new_name").rlike(r"^\s")
    message = F.when(F.col("_current").isNull(), "The finding is no longer current.").when(F.col("_p") == "", "The destination cannot be verified.").when(invalid, "Enter a valid Windows file name.")
    message = message.when(F.col("_n") == F.upper(paths.file_name(F.col("full_path"))), "Choose a different file name.")
    if recommended_only:
        message = message.when(~F.col("new_name").eqNullSafe(F.col("suggestion")), "Use the recommended file name.")
    message = message.when(F.col("_taken"), "A file or folder with the same name already exists.")
    return joined.withColumn("message", message).select(*candidates.columns, "message")


def link_eligibility(pairs: DataFrame, hard: bool = True, known: int = 0x3FFFF, rejected: int = paths.DIRECTORY | paths.REPARSE_POINT | paths.DEVICE) -> DataFrame:
    """pairs of a survivor and a duplicate (columns s_* and d_*: length, expected_length, ticks, expected_ticks, attributes,
    links, is_local, file_system, volume; and same_security, same_streams, same_content) with refusal: the first that holds."""
    c = F.col
    stale = F.lit(False)
    unsafe_ = F.lit(False)
    for x in "sd":
        stale |= (c(f"{x}_length") != c(f"{x}_expected_length")) | (c(f"{x}_ticks") != c(f"{x}_expected_ticks"))
        unsafe_ |= paths.has(c(f"{x}_attributes"), rejected) | (c(f"{x}_attributes").bitwiseAND(~known) != 0)
    refusal = F.when(stale, "The file changed since the duplicate scan.").when(unsafe_, "The file has unsupported or unsafe attributes.")
    refusal = refusal.when(c("s_attributes").bitwiseAND(EQUAL_ATTRIBUTES) != c("d_attributes").bitwiseAND(EQUAL_ATTRIBUTES), "The file attributes no longer match exactly.")
    refusal = refusal.when(c("d_links") != 1, "The duplicate already has more than one physical hard link.")
    if hard:
        ntfs = lambda x: c(f"{x}_is_local") & (F.upper(c(f"{x}_file_system")) == "NTFS")
        refusal = refusal.when(~ntfs("s") | ~ntfs("d"), "Hard-link replacement requires two files on a local NTFS volume.")
        refusal = refusal.when(c("s_volume") != c("d_volume"), "Hard-link replacement requires the survivor and duplicate on the same volume.")
        refusal = refusal.when(c("s_links") >= MOST_LINKS, f"The survivor has reached the NTFS hard-link limit of {MOST_LINKS} links.")
    refusal = refusal.when(~c("same_security"), "The owner, group, DACL, or DACL control state no longer matches.").when(~c("same_streams"), "The alternate data streams no longer match exactly.").when(~c("same_content"), "The files are no longer byte-identical.")
    return pairs.withColumn("refusal", refusal)


def deepest_first(findings: DataFrame) -> DataFrame:
    """Empty folders in the order in which they can be deleted."""
    return findings.orderBy(F.desc(F.col("metadata")["Depth"].cast("int")), *path_order("full_path"))


def repeated_paths(pairs: DataFrame) -> DataFrame:
    """Paths that a link plan (survivor_path, duplicate_path) names more than once across its parts; no row is right."""
    each = pairs.select(F.col("survivor_path").alias("p")).distinct().unionByName(pairs.select(F.col("duplicate_path").alias("p")))
    return each.groupBy(F.upper("p").alias("path_key")).agg(F.count("*").alias("n")).where("n > 1")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two selections has (side a or b); none where they are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))
