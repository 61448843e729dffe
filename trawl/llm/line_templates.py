"""Lines whose template recurs across documents, found with a log-template tree of fixed depth.

A line's path in the tree is its number of tokens and its leading tokens; tokens that hold a digit
are variable fields and read `<*>`. A leaf holds templates at two levels. At the upper one each place
that no single token fills in half of the leaf's lines is a variable field too. Lines that do not
fit this template are generalised one by one: their tokens that few of the leaf's texts have at that
place are fields, so several templates can share a leaf. A template must keep enough fixed places
that hold letters; other lines are their own template.

A template recurs if enough unrelated texts hold it. Copies of a document, near ones too, agree in most
of their traits (how the first, last, middle and two longest lines begin), even where some are
edited; a text counts by itself if most of its traits, other than the line itself, are rare among the
texts with that template, and the others count as many times as most traits have values that are not.
All of it runs as DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, small, table

#: Leading tokens on a line's path, and those of each trait of a text.
DEPTH, AROUND = 2, 3
#: Unrelated texts that a recurring template stands in: in general, and for lines of at least LONG tokens,
#: which hardly recur by chance.
MIN_TEXTS, MIN_LONG, LONG = 8, 3, 40
#: Share of a template's texts from which on a trait's value is common among them, if two have it; and
#: the trait, by falling number of common values, that tells how many groups of copies there are.
COMMON, MOST = 0.01, 3
#: Share of a leaf's lines in which a fixed place has the same token at the upper level, share of fixed
#: wordy places in a template, and their least number at the lower level.
SAME, FIXED, MIN_FIXED = 0.5, 0.5, 4
ANY = "<*>"
_SPACE, _BLANKS = "[\\x20\\x09\\x0B-\\x0D]+", " \t\x0b\x0c\r"


def _tokens(line: Column) -> Column:
    """Tokens with those that hold a digit made variable; a line without tokens has none."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^\\x20\\x09\\x0B-\\x0D]*[0-9][^\\x20\\x09\\x0B-\\x0D]*", ANY)).otherwise(line)
    return F.filter(F.split(masked, _SPACE), lambda x: x != "")


def _start(line: Column) -> Column:
    """The first AROUND blank-separated pieces of a line, without a pass over its rest."""
    return F.substring_index(line, " ", AROUND)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text hash, places and starts of the lines that the text's traits come from, place and line for every line."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.md5(text).alias("hash"), F.split(text, "\n", -1).alias("lines"))
    longest = F.sort_array(F.transform("lines", lambda x, i: F.struct((-F.octet_length(x)).alias("size"), i.alias("place"))))
    d = d.select("id", "hash", "lines", longest.alias("longest"), F.size("lines").alias("k"))
    at = [F.lit(0), F.col("k") - 1, F.floor(F.col("k") / 2).cast("int"), F.col("longest")[0]["place"], F.col("longest")[F.least(F.lit(1), F.col("k") - 1)]["place"]]
    at = F.array(*(x.cast("int") for x in at))
    starts = F.transform(at, lambda x: _start(F.element_at("lines", x + 1)))
    return d.select("id", "hash", at.alias("at"), starts.alias("starts"), F.posexplode("lines").alias("place", "line"))


def _traits() -> Column:
    """The text's traits beside the line at hand; where that is the trait's own line, null."""
    return F.zip_with("at", "starts", lambda x, v: F.when(x != F.col("place"), v))


def _masked(line: Column) -> Column:
    """A line's tokens between single blanks, as one string, which takes less room than an array.

    A line without digits, tabs and doubled or outer blanks is that already.
    """
    odd = line.rlike("[0-9\\x09\\x0B-\\x0D]") | F.contains(line, F.lit("  ")) | line.startswith(" ") | line.endswith(" ")
    return F.when(odd, F.array_join(_tokens(line), " ")).otherwise(line)


def _path(lines: DataFrame) -> DataFrame:
    """Adds masked, and the path n (tokens) and lead (the first of them). Lines without tokens go.

    They are told by the line, as a filter by masked would make Spark work that out twice.
    """
    t = lines.where(F.ltrim("line", F.lit(_BLANKS)) != "").withColumn("masked", _masked(F.col("line"))).drop("line")
    blanks = F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit("")))
    return t.withColumns({"n": blanks + 1, "lead": F.substring_index("masked", " ", DEPTH)})


def _least(n: Column) -> Column:
    """Texts that a template of n tokens must stand in."""
    return F.when(n >= LONG, MIN_LONG).otherwise(MIN_TEXTS)


def _upper(varied: DataFrame, tokens: DataFrame) -> DataFrame:
    """n, lead, own, template of the lines that fit their leaf's upper template."""
    leaf = ["n", "lead"]
    top = tokens.groupBy(*leaf, "all", "at").agg(F.max(F.struct("w", "token")).alias("top"))
    token = F.when(F.col("top.w") >= SAME * F.col("all"), F.col("top.token")).otherwise(ANY)
    shape = top.groupBy(*leaf).agg(F.sort_array(F.collect_list(F.struct("at", token.alias("token")))).alias("shape"))  # as long as a line
    shape = shape.select(*leaf, F.transform("shape", lambda x: x["token"]).alias("shape"))
    shape = saved(shape.where(_fixed("shape") >= FIXED * F.col("n")))
    fits = varied.join(small(shape), leaf)
    fits = fits.where(F.forall(F.zip_with(F.split("masked", " "), "shape", lambda t, s: (s == ANY) | (s == t)), lambda x: x))
    return saved(fits.select(*leaf, "own", F.md5(F.array_join("shape", " ")).alias("template")))


def _lower(varied: DataFrame, tokens: DataFrame) -> DataFrame:
    """n, lead, own, template of lines by the tokens that enough of the leaf's texts have at a place."""
    leaf = ["n", "lead"]
    often = saved(tokens.where(F.col("w") >= MIN_TEXTS).select(*leaf, "at", "token", F.lit(True).alias("often")))
    places = varied.select(*leaf, "own", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    places = places.join(small(often), [*leaf, "at", "token"], "left").withColumn("token", F.when(F.col("often"), F.col("token")).otherwise(ANY))
    lines = places.groupBy(*leaf, "own").agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("shape"))  # as long as a line
    lines = lines.withColumn("shape", F.transform("shape", lambda x: x["token"]))
    lines = lines.where(_fixed("shape") >= F.greatest(F.lit(MIN_FIXED), FIXED * F.col("n")))
    return saved(lines.select(*leaf, "own", F.md5(F.array_join("shape", " ")).alias("template")))


def _fixed(shape: str) -> Column:
    """Fixed places that hold letters: bare signs, as between the cells of a table, say nothing of what a line is."""
    return F.size(F.filter(shape, lambda x: (x != ANY) & x.rlike(r"\p{L}")))


def _recurring(spots: DataFrame) -> DataFrame:
    """n, template of those that enough unrelated texts hold. spots: n, template, hash, place, traits; saved."""
    key = ["n", "template"]
    texts = spots.groupBy(*key, "hash").agg(F.min(F.struct("place", "traits"))["traits"].alias("traits"))
    number = texts.groupBy(*key).agg(F.count("*").alias("texts")).where(F.col("texts") >= _least(F.col("n")))
    texts = saved(texts.join(small(saved(number)), key))
    traits = texts.select(*key, "hash", "texts", F.posexplode("traits").alias("trait", "value")).where(F.col("value").isNotNull())
    common = traits.groupBy(*key, "texts", "trait", "value").agg(F.count("*").alias("c")).where((F.col("c") > 1) & (F.col("c") >= COMMON * F.col("texts")))
    common = saved(common.select(*key, "trait", "value", F.lit(1).alias("is_common")))
    shared = traits.join(small(common), [*key, "trait", "value"], "left").groupBy(*key, "hash").agg(F.count("*").alias("all"), F.count("is_common").alias("shared"))
    own = F.col("all") - F.col("shared")
    alone = shared.groupBy(*key).agg(F.count_if((own > F.col("shared")) & (own > 1)).alias("alone"))
    groups = common.groupBy(*key, "trait").agg(F.count("*").alias("c")).groupBy(*key).agg(F.sort_array(F.collect_list("c"), asc=False).alias("groups"))  # five at most
    families = F.coalesce(F.get("groups", F.lit(MOST - 1)), F.lit(0))
    return saved(alone.join(groups, key, "left").where(F.col("alone") + families >= _least(F.col("n"))).select(*key))


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, hash (of the text), places (array of int, from 0) of the lines whose template recurs.

    A null text counts as empty; lines without tokens are none. A text of one line has nothing beside it
    that could tell a copy, with small edits, from an unrelated text, so it adds to no template's count;
    its line still goes if other texts make the template recur. Of a leaf's equally frequent tokens at a
    place the greatest is the fixed one. Null and repeated ids and repeated rows give their rows' places
    once each; other columns are ignored; an empty table gives an empty result.
    """
    leaf = ["n", "lead"]
    paths = _path(_lines(docs, id_col, text_col))
    # A leaf with fewer lines than a template needs texts holds no recurring one; its lines go no further.
    full = saved(paths.groupBy(*leaf).agg(F.count("*").alias("c")).where(F.col("c") >= _least(F.col("n"))).drop("c"))
    kept = saved(paths.join(small(full), leaf).select("id", "hash", _traits().alias("traits"), "place", *leaf, "masked", F.md5("masked").alias("own")))

    distinct = kept.groupBy(*leaf, "own", "hash").agg(F.first("masked").alias("masked"))
    distinct = saved(distinct.groupBy(*leaf, "own").agg(F.first("masked").alias("masked"), F.count("*").alias("w")))
    # Leaves with one distinct line need no generalising.
    several = saved(distinct.groupBy(*leaf).agg(F.count("*").alias("c"), F.sum("w").alias("all")).where("c > 1").drop("c"))
    varied = distinct.join(small(several), leaf)
    tokens = varied.select(*leaf, "all", "w", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    tokens = saved(tokens.groupBy(*leaf, "all", "at", "token").agg(F.sum("w").alias("w")))
    upper = _upper(varied, tokens)
    general = upper.unionByName(_lower(varied.join(small(upper.select(*leaf, "own")), [*leaf, "own"], "left_anti"), tokens))

    marked = kept.select("id", "hash", "traits", "place", *leaf, "own").join(small(saved(general)), [*leaf, "own"], "left")
    marked = saved(marked.select("id", "hash", "traits", "place", "n", F.coalesce("template", "own").alias("template")))
    recurs = _recurring(marked)
    return marked.join(small(recurs), ["n", "template"]).groupBy("id", "hash").agg(F.sort_array(F.collect_set("place")).alias("places"))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, without the lines whose template recurs across documents.

    Adds n_lines and n_dropped. Lines end at newlines; blank lines are never dropped and a text
    without dropped lines stays as it is, null too (0 lines, as the empty text has 1). A text all
    whose lines are dropped becomes empty. Repeated rows are treated alike and stay; null doc_ids
    keep their rows. Columns named like those added are replaced; an empty table gives an empty result.
    """
    found = recurring_lines(docs, id_col, text_col)
    names = {"id": "__id", "hash": "__hash", "places": "__places"}
    found = found.select(*(F.col(k).alias(v) for k, v in names.items()))
    base = docs.drop("n_lines", "n_dropped")
    keep = base.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = base.join(found, base[id_col].eqNullSafe(found["__id"]) & (F.md5(text) == found["__hash"]), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    rest = F.filter(lines, lambda x, i: ~F.array_contains("__places", i.cast("int")))
    new = F.when(F.col("__places").isNull(), F.col(text_col)).otherwise(F.array_join(rest, "\n"))
    return joined.select(
        *(new.alias(c) if c == text_col else F.col(c) for c in keep),
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("__places").isNull(), 0).otherwise(F.size("__places")).cast("long").alias("n_dropped"),
    )


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and a digest of what is left of each document; a null text has no lines."""
    out = drop_recurring_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, md5(text) AS hash, ls, unnest(ls) AS line, unnest(range(len(ls))) AS place
  FROM (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), o AS (
  SELECT doc_id, hash, place, line, ls, list_sort(list_transform(ls, lambda x, i: {'size': -strlen(x), 'i': i})) AS longest FROM l
), p AS (
  SELECT doc_id, hash, place,
    list_transform([1, len(ls), len(ls) // 2 + 1, longest[1].i, longest[least(2, len(ls))].i], lambda i: CASE WHEN i <> place + 1 THEN array_to_string(string_split(ls[i], ' ')[1:3], ' ') END) AS traits,
    list_filter(regexp_split_to_array(regexp_replace(line, '[^\x20\x09\x0B-\x0D]*[0-9][^\x20\x09\x0B-\x0D]*', '<*>', 'g'), '[\x20\x09\x0B-\x0D]+'), lambda x: x <> '') AS tokens
  FROM o
), q AS (
  SELECT *, len(tokens) AS n, array_to_string(tokens[1:2], ' ') AS lead, md5(array_to_string(tokens, ' ')) AS own FROM p WHERE len(tokens) > 0
), k AS (
  SELECT q.* FROM q JOIN (SELECT n, lead FROM q GROUP BY ALL HAVING count(*) >= CASE WHEN n >= 40 THEN 3 ELSE 8 END) USING (n, lead)
), d AS (
  SELECT n, lead, own, first(tokens) AS tokens, count(DISTINCT hash) AS w FROM k GROUP BY n, lead, own
), v AS (
  SELECT d.*, s.total FROM d JOIN (SELECT n, lead, sum(w) AS total FROM d GROUP BY n, lead HAVING count(*) > 1) s USING (n, lead)
), a AS (
  SELECT n, lead, total, slot, token, sum(w) AS w
  FROM (SELECT n, lead, total, w, unnest(tokens) AS token, unnest(range(len(tokens))) AS slot FROM v) GROUP BY n, lead, total, slot, token
), b AS (
  SELECT n, lead, slot, CASE WHEN max(w) >= 0.5 * total THEN max({'w': w, 'token': token}).token ELSE '<*>' END AS token FROM a GROUP BY n, lead, total, slot
), g AS (
  SELECT n, lead, list(token ORDER BY slot) AS shape FROM b GROUP BY n, lead HAVING count(*) FILTER (token <> '<*>' AND regexp_matches(token, '\p{L}')) >= 0.5 * n
), f AS (
  SELECT v.n, v.lead, v.own, md5(array_to_string(shape, ' ')) AS general FROM v JOIN g USING (n, lead)
  WHERE len(list_filter(list_zip(tokens, shape), lambda z: z[2] <> '<*>' AND z[1] <> z[2])) = 0
), e AS (
  SELECT n, lead, own, list(CASE WHEN a.w >= 8 THEN token ELSE '<*>' END ORDER BY slot) AS shape
  FROM (SELECT n, lead, own, unnest(tokens) AS token, unnest(range(len(tokens))) AS slot FROM v ANTI JOIN f USING (n, lead, own)) JOIN a USING (n, lead, slot, token)
  GROUP BY n, lead, own
), h AS (
  SELECT n, lead, own, general FROM f UNION ALL
  SELECT n, lead, own, md5(array_to_string(shape, ' ')) FROM e WHERE len(list_filter(shape, lambda x: x <> '<*>' AND regexp_matches(x, '\p{L}'))) >= greatest(4, 0.5 * n)
), m AS (
  SELECT k.doc_id, k.hash, k.place, k.traits, k.n, coalesce(h.general, k.own) AS template FROM k LEFT JOIN h USING (n, lead, own)
), t AS (
  SELECT *, count(*) OVER (PARTITION BY n, template) AS texts FROM (SELECT n, template, hash, arg_min(traits, place) AS traits FROM m GROUP BY n, template, hash)
  QUALIFY texts >= CASE WHEN n >= 40 THEN 3 ELSE 8 END
), u AS (
  SELECT n, template, hash, trait, value, count(*) OVER (PARTITION BY n, template, trait, value) AS c, texts
  FROM (SELECT n, template, hash, texts, unnest(traits) AS value, unnest(range(5)) AS trait FROM t) WHERE value IS NOT NULL
), w AS (
  SELECT n, template, count(*) FILTER (own > shared AND own > 1) AS alone FROM (SELECT n, template, hash, count(*) FILTER (NOT (c > 1 AND c >= 0.01 * texts)) AS own, count(*) FILTER (c > 1 AND c >= 0.01 * texts) AS shared FROM u GROUP BY n, template, hash) GROUP BY n, template
), z AS (
  SELECT n, template, list_reverse_sort(list(c))[3] AS families FROM (SELECT n, template, trait, count(DISTINCT value) AS c FROM u WHERE c > 1 AND c >= 0.01 * texts GROUP BY n, template, trait) GROUP BY n, template
), r AS (
  SELECT n, template FROM w LEFT JOIN z USING (n, template) WHERE alone + coalesce(families, 0) >= CASE WHEN n >= 40 THEN 3 ELSE 8 END
), x AS (
  SELECT doc_id, hash, list(DISTINCT place) AS places FROM m JOIN r USING (n, template) GROUP BY doc_id, hash
)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (list_contains(x.places, l.place)) AS n_dropped,
  md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.place) FILTER (x.places IS NULL OR NOT list_contains(x.places, l.place)), '')) AS text_md5
FROM l LEFT JOIN x ON l.doc_id IS NOT DISTINCT FROM x.doc_id AND l.hash = x.hash
GROUP BY l.doc_id
"""
