"""Operator 3 [native]: line dedup by a log-template tree. Lines are parsed by token count and leading tokens into leaves,
variable fields become wildcards, and lines whose template recurs across documents are dropped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filegrove.llm.common import fresh, let, text_key
from filegrove.operators.graph import connected
from filegrove.operators.tables import Scratch, stored

WILDCARD = "<*>"
#: Lines or blocks of which one or two numbers (8 bytes each) are broadcast for a join; and numbers (4 bytes each) in the keys and
#: places of texts that are. Beyond, the join is by a shuffle.
BROADCAST_LINES, BROADCAST_NUMBERS = 2_000_000, 8_000_000


@dataclass(frozen=True)
class Tree:
    """depth: leading tokens that choose a leaf beside the token count. Lines of min_tokens tokens or more have variable
    fields: two lines of a leaf agree if at least constant_share of their tokens do.

    Templates of a leaf: in a fixed order (lines in min_docs texts or more first, then by hash) each line that doesn't agree
    with an earlier template becomes one; all lines of the leaf that agree with a template belong to it. A template recurs
    if its lines stand in min_docs different texts, copies of one text counting once. Whether two texts are copies is judged
    by what they share beside the template that makes up most of it: at least link_share of the rest of the one stands in lines
    whose templates the other has as well, and copy_share of it in lines that recur at all; or they share other lines, and
    word_share of the rest of its shingles (runs of five words). Copies of copies are copies. Texts that are nothing but the
    template count as one."""

    depth: int = 2
    min_docs: int = 3
    min_tokens: int = 4
    constant_share: float = 0.7
    copy_share: float = 0.6
    link_share: float = 0.3
    word_share: float = 0.3


def masked(line: Column) -> Column:
    """A line's tokens, one blank between them, those with a digit as wildcards. One look tells whether there is anything
    to do but to trim."""
    plain = F.trim(line)
    spaced = F.trim(F.regexp_replace(plain, r"\s+", " "))
    return F.when(line.rlike(r"[0-9\t\x0B\f\r]|  "), F.regexp_replace(spaced, "[^ 0-9]*+[0-9][^ ]*", WILDCARD)).otherwise(plain)


def _lines(df: DataFrame, text: str, tree: Tree) -> DataFrame:
    """(id, key, whole, place, chars, tokens, leaf, template, line) of each line with tokens: key stands for its text, chars
    and whole are the lengths of the line and of all such lines of the text, template is the hash of the line with wildcards
    in the place of numbers."""
    told = lambda line: (F.trim(line) >= "!") | line.rlike(r"\S")
    keyed = df.select(text_key(text).alias("key"), F.split(F.col(f"`{text}`").cast("string"), "\n").alias("lines"))
    whole = F.aggregate(F.filter("lines", told), F.lit(0), lambda n, line: n + F.length(line))
    keyed = keyed.select("key", "lines", whole.alias("whole"))  # before lines are rows, else each one has them all
    rows = keyed.select("key", "whole", F.posexplode("lines").alias("place", "raw")).where(told(F.col("raw")))
    rows = rows.select("key", "whole", "place", F.length("raw").alias("chars"), masked(F.col("raw")).alias("line"))
    tokens = (F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1).cast("int")
    leaf = F.xxhash64(tokens, F.substring_index("line", " ", tree.depth))
    return rows.select(F.monotonically_increasing_id().alias("id"), "key", "whole", "place", "chars", tokens.alias("tokens"), leaf.alias("leaf"), F.xxhash64("line").alias("template"), "line")


def _constant(tokens: Column, tree: Tree) -> Column:
    """How many of a line's tokens must agree with its template's."""
    return F.ceil(tokens * tree.constant_share).cast("int")


def _sent(rows: DataFrame, width: int = 2, most: int | None = None) -> DataFrame:
    """A table of width numbers (8 bytes each) a row, for a join: to all tasks up to BROADCAST_LINES rows of two numbers, by a
    shuffle beyond. most: it has no more rows, if known; where these are few enough, they needn't be counted."""
    few = most is not None and most * width <= 2 * BROADCAST_LINES
    return F.broadcast(rows) if few or rows.count() * width <= 2 * BROADCAST_LINES else rows


def _rarest(words: DataFrame, tree: Tree, keep: Scratch, n: int) -> DataFrame:
    """(template, rank, key), a table: the tokens of each line, with their places, that are rarest in its leaf, one more than
    there may be variable fields. Two lines that agree share one of them: of the tokens that they share, one at least
    is among each one's rarest, and the order is the same for all. What no other line of the leaf has can't be shared."""
    behind = F.slice("words", tree.depth + 1, F.greatest(F.size("words") - tree.depth, F.lit(1)))
    each = keep(words.select("template", "rank", "tokens", F.posexplode(behind).alias("at", "token"), "leaf").select("template", "rank", "tokens", F.xxhash64("leaf", "at", "token").alias("key")), "tokens", 10 * n)
    often = keep(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "often", 10 * n)
    shared = each.join(_sent(often), "key").groupBy("template", "rank", "tokens").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("keys"), F.count("*").alias("shared"))
    # those without another line's company are the rarest of all
    most = F.col("tokens") - _constant(F.col("tokens"), tree) + 1 - (F.col("tokens") - tree.depth - F.col("shared"))
    return keep(shared.select("template", "rank", F.explode(F.slice("keys", 1, F.greatest(most, F.lit(0)).cast("int"))).alias("x")).select("template", "rank", "x.key"), "rarest", 10 * n)


def _generalised(lines: DataFrame, templates: DataFrame, tree: Tree, keep: Scratch, n: int) -> DataFrame:
    """(line, template) hashes, a table: which lines agree with which of the n templates of their leaf.

    Lines are compared only where they share one of their rarest tokens. In each round the lines that come before all others
    that they share such a token with become templates; who agrees with one leaves, the others wait for the next round. So
    every pair that is compared has a template in it, and no line is left without one."""
    wide = templates.where(F.col("tokens") >= max(tree.min_tokens, tree.depth + 1))
    # a leaf with a single line, or with too few texts, has nothing to generalise
    leaves = keep(wide.groupBy("leaf").agg(F.count("*").alias("n"), F.sum("texts").alias("texts")).where((F.col("n") > 1) & (F.col("texts") >= tree.min_docs)).select("leaf"), "leaves", n)
    some = keep(wide.join(_sent(leaves, most=n), "leaf", "left_semi"), "some", n)
    n_some = n = some.count()
    words = lines.select("id", "line").join(_sent(some, 5, n), "id")
    rank = F.conv(F.substring(F.md5("line"), 1, 15), 16, 10).cast("long") + F.when(F.col("texts") >= tree.min_docs, 1 << 60).otherwise(0)
    words = keep(words.select("template", "tokens", rank.alias("rank"), F.split("line", " ").alias("words"), "leaf"), "words", 10 * n)
    rarest = _rarest(words, tree, keep, n)
    left, found, total, n_rarest = rarest, [], 0, None
    side = lambda pairs, name, column: words.join(_sent(pairs.select(F.col(name).alias("template")).distinct(), most=n_some), "template", "left_semi").select(F.col("template").alias(name), "tokens", F.col("words").alias(column))
    agree = F.size(F.filter(F.zip_with("words", "others", lambda a, b: a == b), lambda same: same))
    while (n := left.count()):
        n_rarest = n_rarest or n
        first = left.groupBy("key").agg(F.max(F.struct("rank", "template")).alias("first"))
        leads = left.join(_sent(first, 3, n), "key").groupBy("template").agg(F.min((F.col("template") == F.col("first.template")).cast("int")).alias("leads"))
        led = keep(leads.where("leads = 1").select(F.col("template").alias("family")), "led", n)
        met = keep(rarest.join(_sent(rarest.join(_sent(led.withColumnRenamed("family", "template"), most=n), "template", "left_semi").select("key", F.col("template").alias("family")), most=n_rarest), "key").where("template <> family").select("template", "family").distinct(), "met", n)
        few = 10 * met.count()
        total += few
        pairs = met.join(side(met, "template", "words"), "template").join(side(met, "family", "others").drop("tokens"), "family")
        agreed = keep(pairs.where(agree >= _constant(F.col("tokens"), tree)).select("template", "family"), "agreed", few)
        found.append(agreed)
        settled = led.select(F.col("family").alias("template")).unionByName(agreed.select("template")).distinct()
        now = keep(left.join(_sent(settled, most=n_some), "template", "left_anti"), "left", n)
        keep.drop(led, met, *([left] if left is not rarest else []))
        left = now
    keep.drop(leaves, some, words)
    out = found[0] if found else rarest.select("template", F.col("template").alias("family"))
    for more in found[1:]:
        out = out.unionByName(more)
    return keep(out, "families", total)


def _shingles(text: Column) -> Column:
    """Hashes of the runs of five words of a text, each once."""
    words = F.array_remove(F.split(text, r"\s+"), "")
    return let(words, lambda w: F.when(F.size(w) > 4, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(5)), " "))))).otherwise(F.array().cast("array<bigint>")))


def _alike(pairs: DataFrame, texts: DataFrame, tree: Tree, keep: Scratch) -> DataFrame:
    """The pairs (a, b, whole, most) of which word_share of a's shingles, beside those of the largest template that both have
    (as many as its share of the text), are b's."""
    n = pairs.count()
    some = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    told = keep(texts.join(_sent(keep(some, "compared", n), 3, 2 * n), "key", "left_semi").dropDuplicates(["key"]).select("key", _shingles(F.col("text")).alias("shingles")), "shingles")
    side = lambda x: told.join(_sent(pairs.select(F.col(x).alias("key")).distinct(), 3, n), "key", "left_semi")
    lead = keep(side("b").select(F.col("key").alias("b"), F.col("shingles").alias("others")), "led-shingles", n)
    few = lead.agg(F.coalesce(F.sum(F.size("others") * 2 + 8), F.lit(0))).first()[0] <= BROADCAST_NUMBERS
    met = side("a").withColumnRenamed("key", "a").join(_sent(pairs, 5, n), "a").join(F.broadcast(lead) if few else lead, "b")
    total = F.size("shingles").cast("long")
    common = F.size(F.array_intersect("shingles", "others")).cast("long")
    return met.where((total > 0) & (common * F.col("whole") - total * F.col("most") >= total * (F.col("whole") - F.col("most")) * tree.word_share)).select("a", "b")


def recurring_templates(lines: DataFrame, texts: DataFrame, tree: Tree, keep: Scratch, n_lines: int) -> DataFrame:
    """The templates (hashes) of lines that recur, each once. texts: (key, text); n_lines: rows of lines.

    Each line with its numbers as wildcards and each template is a set of lines. A set recurs if its lines stand in min_docs different
    texts that aren't copies. Of each set the text with the least key leads, and texts are held against the leaders of the
    sets that they share in; linked texts are one class."""
    seen = lines.select("template", "leaf", "tokens", "key", "id").groupBy("template", "leaf", "tokens", "key").agg(F.min("id").alias("id"))
    templates = keep(seen.groupBy("template", "leaf", "tokens").agg(F.min("id").alias("id"), F.count("*").alias("texts")), "templates", n_lines)
    n_templates = templates.count()
    other = _generalised(lines, templates, tree, keep, n_templates)
    alone = templates.where(F.col("texts") >= tree.min_docs).select("template", F.col("template").alias("family"))
    # a family is named by one of its templates, which belongs to it even where it doesn't recur by itself
    member = keep(other.unionByName(alone).unionByName(other.select(F.col("family").alias("template"), "family")).distinct(), "members", n_templates + 3 * other.count())
    n_member = member.count()
    places = keep(lines.join(_sent(member.select("template").distinct(), most=n_member), "template", "left_semi").groupBy("template", "key", "place", "whole").agg(F.max("chars").alias("chars")), "places", n_lines)
    n = places.count()
    found = places.join(_sent(member, most=n_member), "template")
    sets = found.select("family", "key").distinct().groupBy("family").agg(F.min("key").alias("leader"), F.count("*").alias("texts"))
    sets = keep(sets.where(F.col("texts") >= tree.min_docs).drop("texts"), "sets", 2 * n)
    within = keep(found.join(_sent(sets, 3, n_member), "family").select("family", "leader", "key", "place", "whole", "chars"), "within", 2 * n)
    own = keep(within.groupBy("family", "leader", "key", "whole").agg(F.sum("chars").alias("own")), "own", 2 * n)
    held = within.groupBy("key", "leader", "place", "whole").agg(F.max("chars").alias("chars")).groupBy("key", "leader", "whole").agg(F.sum("chars").alias("shared"))
    most = own.groupBy("key", "leader").agg(F.max("own").alias("most"))
    covered = within.groupBy("key", "place").agg(F.max("chars").alias("chars")).groupBy("key").agg(F.sum("chars").alias("covered"))
    rest = F.col("whole") - F.col("most")
    beside = F.col("shared") - F.col("most")
    linked = (beside >= rest * tree.link_share) & (F.col("covered") - F.col("most") >= rest * tree.copy_share)
    met = held.join(most, ["key", "leader"]).join(_sent(keep(covered, "covered", n), 3, n), "key").where((rest > 0) & (beside > 0) & (F.col("key") != F.col("leader")))
    near = keep(met.select(F.col("key").alias("a"), F.col("leader").alias("b"), "whole", "most", beside.alias("beside"), linked.alias("linked")), "near", 2 * n)
    best = F.max(F.struct("beside", "b", "whole", "most")).alias("x")
    open_ = keep(near.groupBy("a").agg(F.max("linked").alias("linked"), best).where("NOT linked").select("a", "x.b", "x.whole", "x.most"), "open", n)
    links = keep(near.where("linked").select("a", "b").unionByName(_alike(open_, texts, tree, keep)), "links", n)
    classes = connected(links, "line-copies").select(F.col("node").alias("key"), "label")
    unit = F.when(F.col("whole") == F.col("own"), F.lit(b"")).otherwise(F.coalesce("label", "key"))
    counted = own.join(_sent(classes, 4), "key", "left").select("family", unit.alias("unit")).distinct().groupBy("family").agg(F.count("*").alias("units"))
    recurring = keep(counted.where(F.col("units") >= tree.min_docs).select("family"), "recurring", 2 * n)
    return member.join(_sent(recurring, most=n_member), "family", "left_semi").select("template").distinct()


def drop_recurring_lines(df: DataFrame, text: str = "text", tree: Tree = Tree(), dropped: str = "dropped_lines") -> DataFrame:
    """df with its texts without the lines of recurring templates, and the number of lines that went.

    Every line of a recurring template goes, in every text. Templates are counted over different texts, so exact copies count
    once, and so do copies with changes (see Tree): what only the copies of one text share doesn't recur. Blank lines stay.
    Null and empty texts stay as they are, rows are neither lost nor merged, and repeated rows get the same text. A column
    of df with the name of dropped is replaced.
    """
    df = df.drop(dropped)
    with Scratch("lines") as keep:
        lines = keep(_lines(df, text, tree), "parsed")
        n = lines.count()
        texts = df.select(text_key(text).alias("key"), F.col(f"`{text}`").cast("string").alias("text")).where("text IS NOT NULL")
        gone = keep(recurring_templates(lines, texts, tree, keep, n), "gone", n)
        key, flags = fresh(df, "line_key", "line_places")
        places = lines.join(_sent(gone), "template", "left_semi").groupBy("key").agg(F.sort_array(F.collect_set("place")).alias(flags))
        decided = stored(places.withColumnRenamed("key", key), "line-decisions", n)
    numbers = decided.agg(F.coalesce(F.sum(F.size(flags) + 8), F.lit(0))).first()[0]
    few = numbers <= BROADCAST_NUMBERS  # else texts are shuffled
    both = df.withColumn(key, text_key(text)).join(F.broadcast(decided) if few else decided, key, "left")
    return both.withColumns({text: F.when(F.col(flags).isNull(), F.col(f"`{text}`")).otherwise(_without(F.col(f"`{text}`"), F.col(flags))), dropped: F.when(F.col(flags).isNull(), F.lit(0)).otherwise(F.size(flags))}).select(*df.columns, dropped)


def _without(text: Column, places: Column) -> Column:
    """A text without the lines at these sorted places: what stands between each two of them, so about linear work."""
    starts = F.concat(F.array(F.lit(-1)), places)

    def kept(lines: Column) -> Column:
        return F.flatten(F.zip_with(starts, F.concat(places, F.array(F.size(lines))), lambda a, b: F.slice(lines, a + 2, b - a - 1)))

    return F.array_join(let(F.split(text, "\n"), kept), "\n")


#: DuckDB SQL for drop_recurring_lines(documents) with the usual Tree: doc_id, n_lines, dropped_lines, text. The templates of a
#: leaf are chosen one by one from all its lines.
ORACLE = r"""
WITH RECURSIVE txt AS (SELECT DISTINCT text, md5(text) AS key FROM documents WHERE text IS NOT NULL),
raw AS (SELECT key, i AS place, string_split(text, chr(10))[i] AS line FROM txt, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i)),
ln AS (SELECT key, place, length(line) AS chars, regexp_replace(trim(regexp_replace(line, '[\t\n\x0b\f\r ]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS m FROM raw),
l AS MATERIALIZED (SELECT *, string_split(m, ' ') AS w, len(string_split(m, ' ')) AS n, sum(chars) OVER (PARTITION BY key) AS whole FROM ln WHERE m <> ''),
tm AS MATERIALIZED (SELECT m, any_value(w) AS w, any_value(n) AS n, any_value(n || ' ' || array_to_string(w[1:2], ' ')) AS leaf, count(DISTINCT key) AS texts FROM l GROUP BY m),
wd AS MATERIALIZED (SELECT *, ceil(n * 0.7::DOUBLE)::INT AS need, ('0x' || substr(md5(m), 1, 15))::BIGINT + CASE WHEN texts >= 3 THEN 1152921504606846976 ELSE 0 END AS rank
       FROM tm WHERE n >= 4 AND leaf IN (SELECT leaf FROM tm WHERE n >= 4 GROUP BY leaf HAVING count(*) > 1 AND sum(texts) >= 3)),
tr AS (SELECT leaf, any_value(n) AS n, any_value(need) AS need, list({'m': m, 'w': w} ORDER BY rank DESC) AS todo FROM wd GROUP BY leaf
       UNION ALL SELECT leaf, n, need, list_filter(todo[2:], lambda x: len(list_filter(range(1, n + 1), lambda i: x.w[i] = todo[1].w[i])) < need) FROM tr WHERE len(todo) > 1),
ld AS (SELECT leaf, todo[1].m AS family, todo[1].w AS v FROM tr WHERE len(todo) > 0),
fm AS (SELECT m, family FROM wd JOIN ld USING (leaf) WHERE m <> family AND len(list_filter(range(1, n + 1), lambda i: w[i] = v[i])) >= need),
mb AS (SELECT m, family FROM fm UNION SELECT family, family FROM fm UNION SELECT m, m FROM tm WHERE texts >= 3),
fd AS (SELECT family, key, place, chars, whole FROM l JOIN mb USING (m)),
st AS (SELECT family, min(key) AS leader FROM fd GROUP BY family HAVING count(DISTINCT key) >= 3),
ow AS (SELECT family, leader, key, any_value(whole) AS whole, sum(chars) AS own FROM fd JOIN st USING (family) GROUP BY family, leader, key),
sh AS (SELECT key, leader AS near, sum(chars) AS shared FROM (SELECT DISTINCT key, leader, place, chars FROM fd JOIN st USING (family)) GROUP BY key, leader),
mo AS (SELECT key, leader AS near, max(own) AS most, any_value(whole) AS whole FROM ow GROUP BY key, leader),
cv AS (SELECT key, sum(chars) AS covered FROM (SELECT DISTINCT key, place, chars FROM fd JOIN st USING (family)) GROUP BY key),
mt AS (SELECT key AS a, near AS b, whole, most, shared - most AS beside, shared - most >= (whole - most) * 0.3::DOUBLE AND covered - most >= (whole - most) * 0.6::DOUBLE AS linked
       FROM sh JOIN mo USING (key, near) JOIN cv USING (key) WHERE key <> near AND whole > most AND shared > most),
op AS (SELECT a, b, whole, most FROM (SELECT *, bool_or(linked) OVER (PARTITION BY a) AS known, row_number() OVER (PARTITION BY a ORDER BY beside DESC, b DESC) AS r FROM mt) WHERE NOT known AND r = 1),
wo AS (SELECT key, list_filter(regexp_split_to_array(text, '[\t\n\x0b\f\r ]+'), lambda x: x <> '') AS w FROM txt WHERE key IN (SELECT a FROM op UNION SELECT b FROM op)),
sg AS MATERIALIZED (SELECT key, CASE WHEN len(w) < 5 THEN [] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM wo),
al AS (SELECT a, b FROM (SELECT a, b, whole, most, len(x.g) AS total, len(list_intersect(x.g, y.g)) AS common FROM op JOIN sg x ON x.key = a JOIN sg y ON y.key = b)
       WHERE total > 0 AND common * whole - total * most >= total * (whole - most) * 0.3::DOUBLE),
ed AS (SELECT a, b FROM mt WHERE linked UNION SELECT a, b FROM al),
nb AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
rc AS (SELECT a AS key, a AS label FROM nb UNION SELECT nb.b, label FROM rc JOIN nb ON rc.key = nb.a),
cl AS (SELECT key, min(label) AS label FROM rc GROUP BY key),
un AS (SELECT family, CASE WHEN whole = own THEN '' ELSE coalesce(label, key) END AS unit FROM ow LEFT JOIN cl USING (key)),
gone AS (SELECT DISTINCT m FROM mb WHERE family IN (SELECT family FROM un GROUP BY family HAVING count(DISTINCT unit) >= 3)),
dc AS (SELECT key, list(place) AS places FROM l JOIN gone USING (m) GROUP BY key)
SELECT doc_id, coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines, coalesce(len(places), 0)::INT AS dropped_lines,
  CASE WHEN places IS NULL THEN d.text ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(places, i)), chr(10)) END AS text
FROM documents d LEFT JOIN dc ON md5(d.text) = dc.key
"""
