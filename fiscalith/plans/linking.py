"""Entity linking: free text to program elements by number, acronym, spelling and vector."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fiscalith.functions import text as X
from fiscalith.functions.similarity import Candidates, token_set_ratio, weighted_ratio
from fiscalith.operators.vectors import hashed_embedding, top_k_cosine
from fiscalith.plans.registry import query
from fiscalith.plans.sql_terms import cosines, hashed_vectors, words
from fiscalith.plans.trends import BASE_SQL, elements
from fiscalith.session import cut_lineage, ship_package
from fiscalith.sources.tables import read_table

#: Fuzzy queries held against one scan of the titles at most; more are done in further scans.
QUERY_BLOCK = 4096
#: Rows of elements whose titles one task compares, and the least number of queries it compares them with.
TASK_ROWS = 1 << 16
TASK_QUERIES = 16
#: Titles whose bounds are computed at a time.
TILE_TEXTS = 1 << 15
PREFIX_SLACK = 2

_CANDIDATE = ["pe_id", "pe_number", "program_name", "agency", "budget_activity"]


def acronym_index(elements: DataFrame) -> DataFrame:
    """``acronym`` (key) and the element whose title has it, once each; classified elements are in it too."""
    return elements.select("pe_id", "pe_number", F.explode(X.title_acronyms(F.col("program_name"))).alias("acronym")).where(
        F.col("acronym") != ""
    )


def _prefixes(c: Column) -> Column:
    """The key and what is left of it without its last one and two characters."""
    return F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(PREFIX_SLACK)), lambda k: F.struct(k.alias("cut"), F.left(c, F.length(c) - k).alias("part"))),
        lambda s: F.length(s["part"]) > 0,
    )


def acronym_lookup(lookups: DataFrame, index: DataFrame) -> DataFrame:
    """``query``, ``position``, ``pe_id``, ``pe_number``, ``acronym``, ``score`` for rows (query, position, key).

    Equal keys score 1.0; if a lookup has none, keys that begin with it and are at most two longer score 0.9; if there are
    none of these either, keys that it begins with score 0.85. Both prefix rules are equi-joins on keys shortened by nought
    to two characters, not a comparison of every lookup with every key.
    """
    keyed = lookups.where(F.length("key") > 0)
    exact = keyed.join(index.withColumnRenamed("acronym", "__acr"), F.col("key") == F.col("__acr"))
    longer = index.select("*", F.explode(_prefixes(F.col("acronym"))).alias("__p")).where("__p.cut > 0")
    shorter = keyed.select("*", F.explode(_prefixes(F.col("key"))).alias("__p")).where("__p.cut > 0")
    columns = ["query", "position", "pe_id", "pe_number"]
    tiers = [
        exact.select(*columns, F.col("__acr").alias("acronym"), F.lit(1.0).alias("score")),
        keyed.join(longer, F.col("key") == F.col("__p.part")).select(*columns, "acronym", F.lit(0.9).alias("score")),
        shorter.join(index, F.col("acronym") == F.col("__p.part")).select(*columns, "acronym", F.lit(0.85).alias("score")),
    ]
    best = F.max("score").over(Window.partitionBy("query", "position"))
    return (
        tiers[0].unionByName(tiers[1]).unionByName(tiers[2]).withColumn("__best", best).where("score = __best").drop("__best")
    )


def acronym_matches(lookups: DataFrame, index: DataFrame) -> DataFrame:
    """Lookups of a query together, each element once: the score of the first lookup that finds it, not the best."""
    hits = acronym_lookup(lookups, index)
    first = Window.partitionBy("query", "pe_id").orderBy("position", F.desc("score"), "acronym")
    return hits.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "position")


def search_text(prepared: Column, raw: Column) -> Column:
    """What is searched for: the prepared text expanded, else normalized, else, if nothing is left of either, the text as it is."""
    return F.coalesce(F.nullif(prepared["expanded"], F.lit("")), F.nullif(prepared["normalized"], F.lit("")), raw)


def fuzzy_matches(queries: DataFrame, elements: DataFrame, top_n: int = 5, cutoff: float = 55.0, block: int = QUERY_BLOCK) -> DataFrame:
    """``query``, ``pe_id``, ``score`` (0-100, one decimal), ``match_on``, ``rank`` of unclassified titles close in spelling.

    Two comparisons, each of which keeps three times ``top_n``: the prepared query with the prepared title, and the query as it is
    with the title as it is. The better one counts, the prepared one at equal scores. A query of which preparing leaves nothing, one of
    stop words only, is compared in lower case instead. ``queries`` has a column ``query``. The queries are the stated set: counted, and
    held against all titles ``block`` at a time, each further part in a scan whose result is written down before the next.

    Equal titles are compared once: they come with the first ids that have them, as many as are kept. A task reads its titles batch by batch. For each
    query it first bounds the scores of a batch from the characters and words in common, all at once, and then compares in the order of these bounds
    until none is above the least score kept: the result is that of comparing all. Each task has to find its own least score, so titles are not
    spread further than ``TASK_ROWS``; where that leaves cores without work, the same titles go to several tasks, each with its share of the queries.
    """
    ship_package(elements.sparkSession)
    texts = queries.where(F.trim("query") != "").select("query").distinct()
    prepared = texts.select("query", X.processed_query(F.col("query")).alias("__p")).select(
        "query", search_text(F.col("__p"), F.lower("query")).alias("expanded")
    )
    prepared = prepared.where(X.stripped(F.col("expanded")) != "")
    named = elements.where(~F.col("is_classified") & (F.col("program_name") != ""))
    asked = prepared.count()
    parts = max(1, -(-asked // block))
    keep = 3 * top_n
    blocks = max(1, -(-named.count() // TASK_ROWS))
    groups = max(1, min(-(-2 * elements.sparkSession.sparkContext.defaultParallelism // blocks), asked // parts // TASK_QUERIES))
    forms = F.array(X.processed_query(F.col("program_name"))["expanded"], F.col("program_name"))
    firsts = Window.partitionBy("leg", "text").orderBy("pe_id")
    titles = named.select("pe_id", F.posexplode(forms).alias("leg", "text")).withColumn("__n", F.row_number().over(firsts)).where(F.col("__n") <= keep)
    titles = titles.groupBy("leg", "text").agg(F.sort_array(F.collect_list("pe_id")).alias("ids"))
    if parts > 1:
        titles = cut_lineage(titles)
    titles = titles.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    titles = titles.repartitionById(groups * blocks, (F.col("group") * blocks + F.pmod(F.xxhash64("text"), F.lit(blocks))).cast("int"))
    schema = "query string, pe_id bigint, leg int, score double"
    found = None
    for part in range(parts):
        mine = prepared if parts == 1 else prepared.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part)
        shared = elements.sparkSession.sparkContext.broadcast([tuple(r.values()) for r in mine.toArrow().to_pylist()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            mine, best, tiles = [], {}, ([], [])

            def compare(leg: int) -> None:
                tile = Candidates(*zip(*tiles[leg]))
                tiles[leg].clear()
                for (of, text), heap in best.items():
                    if of != leg:
                        continue
                    sure, most = tile.set_limits(text) if leg else tile.weighted_limits(text)
                    tile.best(most, partial(token_set_ratio if leg else weighted_ratio, text), cutoff, keep, heap, leg == 0, sure)

            for batch in batches:
                legs, texts, ids, group = (c.to_pylist() for c in batch.columns)
                if legs and not best:
                    mine = shared.value[group[0] :: groups]
                    best = {(leg, r[1 - leg]): [] for r in mine for leg in (0, 1)}
                for leg, text, at in zip(legs, texts, ids):
                    tiles[leg].append((at, text))
                    if len(tiles[leg]) == TILE_TEXTS:
                        compare(leg)
            for leg in (0, 1):
                if tiles[leg]:
                    compare(leg)
            rows = [(r[0], -i, leg, s) for r in mine for leg in (0, 1) for s, i in best[leg, r[1 - leg]]]
            q, i, leg, s = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, pa.string()), pa.array(i, pa.int64()), pa.array(leg, pa.int32()), pa.array(s, pa.float64())],
                names=["query", "pe_id", "leg", "score"],
            )

        one = titles.mapInArrow(run, schema)
        if parts > 1:
            one = cut_lineage(one)
            shared.destroy()
        found = one if found is None else found.unionByName(one)
    in_leg = Window.partitionBy("query", "leg").orderBy(F.desc("score"), "pe_id")
    legs = found.withColumn("__n", F.row_number().over(in_leg)).where(F.col("__n") <= keep)
    merged = legs.groupBy("query", "pe_id").agg(
        F.max("score").alias("__s"), F.max_by("leg", F.struct("score", -F.col("leg"))).alias("leg"), F.min(F.struct("leg", "__n")).alias("__place")
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), "__place", "pe_id")
    return (
        merged.withColumn("score", F.round("__s", 1))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_n)
        .select("query", "pe_id", "score", F.when(F.col("leg") == 0, "normalized").otherwise("original").alias("match_on"), "rank")
    )


def semantic_matches(queries: DataFrame, elements: DataFrame, top_n: int = 5, threshold: float = 0.35, embed=hashed_embedding) -> DataFrame:
    """``query``, ``pe_id``, ``score``, ``rank`` of unclassified titles close as vectors; ``embed`` makes a vector of a text column."""
    q = queries.where(F.trim("query") != "").select("query").distinct()
    q = q.withColumn("__p", X.processed_query(F.col("query"))).select("query", embed(search_text(F.col("__p"), F.col("query"))).alias("__v"))
    titles = elements.where(~F.col("is_classified")).select("pe_id", "program_name", X.processed_query(F.col("program_name")).alias("__p"))
    titles = titles.select("pe_id", embed(search_text(F.col("__p"), F.col("program_name"))).alias("__v"))
    return top_k_cosine(q, "query", "__v", titles, "pe_id", "__v", top_n, threshold)


def best_fuzzy_match(queries: DataFrame, elements: DataFrame, cutoff: float = 75.0) -> DataFrame:
    """``query``, ``pe_id``, ``program_name`` and ``score`` of the closest title of each query; none below ``cutoff``."""
    best = fuzzy_matches(queries, elements, 1, cutoff)
    return best.join(elements.select("pe_id", "program_name"), "pe_id").select("query", "pe_id", "program_name", "score")


def best_semantic_match(queries: DataFrame, elements: DataFrame, threshold: float = 0.45, embed=hashed_embedding) -> DataFrame:
    """The same by vectors."""
    best = semantic_matches(queries, elements, 1, threshold, embed)
    return best.join(elements.select("pe_id", "program_name"), "pe_id").select("query", "pe_id", "program_name", "score")


def link_queries(
    queries: DataFrame,
    elements: DataFrame,
    top_n: int = 5,
    fuzzy_cutoff: float = 60.0,
    semantic_threshold: float = 0.35,
    embed=hashed_embedding,
) -> DataFrame:
    """The waterfall: number, acronym, spelling, vector; the first stage that finds anything gives all candidates of a query.

    One row a candidate with ``matched``, ``match_stage``, ``rank``, the element, ``score`` (0-1) and ``match_detail``; a query that nothing
    finds, blank ones included, has one row MANUAL_REVIEW of rank 0. Each stage sees only the queries that earlier ones left, so the costly
    ones run on few. Equal queries are linked once.
    """
    asked = queries.select(X.stripped(F.coalesce("query", F.lit(""))).alias("query")).distinct()
    parsed = cut_lineage(asked.select("query", X.processed_query(F.col("query")).alias("p")))
    left = parsed.where(F.col("query") != "")

    by_number = left.where(F.col("p.pe_number_detected").isNotNull()).join(
        elements, F.col("p.pe_number_detected") == elements.pe_number
    )
    number_rank = F.row_number().over(Window.partitionBy("query").orderBy("pe_id"))
    stage0 = cut_lineage(
        by_number.select(
            "query", "pe_id", F.lit(1.0).alias("score"), number_rank.alias("rank"),
            F.concat(F.lit("Exact PE number match: "), F.col("p.pe_number_detected")).alias("match_detail"),
        )
    )
    left = left.join(stage0, "query", "left_anti")

    tried = F.array_distinct(F.concat(F.col("p.acronyms"), F.array("query")))
    lookups = left.select("query", F.posexplode(tried).alias("position", "__a")).select("query", "position", X.acronym_key(F.col("__a")).alias("key"))
    acronyms = acronym_matches(lookups, cut_lineage(acronym_index(elements)))  # three joins read the index
    acronym_rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "pe_number", "pe_id"))
    stage1 = cut_lineage(
        acronyms.withColumn("rank", acronym_rank)
        .where(F.col("rank") <= top_n)
        .select("query", "pe_id", "score", "rank", F.format_string("Acronym match: '%s' found in title", "acronym").alias("match_detail"))
    )
    left = left.join(stage1, "query", "left_anti")

    stage2 = cut_lineage(
        fuzzy_matches(left, elements, top_n, fuzzy_cutoff).select(
            "query", "pe_id", F.round(F.col("score") / 100, 4).alias("score"), "rank",
            F.format_string("Fuzzy score: %.0f/100 (matched on %s)", "score", "match_on").alias("match_detail"),
        )
    )
    left = left.join(stage2, "query", "left_anti")

    stage3 = semantic_matches(left, elements, top_n, semantic_threshold, embed).select(
        "query", "pe_id", F.round("score", 4).alias("score"), "rank", F.format_string("Semantic similarity: %.3f", "score").alias("match_detail")
    )
    stages = (("PE_NUMBER", stage0), ("ACRONYM", stage1), ("FUZZY", stage2), ("SEMANTIC", stage3))
    found = None
    for name, df in stages:
        part = df.withColumn("match_stage", F.lit(name))
        found = part if found is None else found.unionByName(part)
    found = found.join(elements.select(*_CANDIDATE), "pe_id")
    out = asked.join(found, "query", "left")
    none = F.col("match_stage").isNull()
    return out.select(
        "query",
        (~none).alias("matched"),
        F.coalesce("match_stage", F.lit("NONE")).alias("match_stage"),
        F.coalesce("rank", F.lit(0)).alias("rank"),
        "pe_id",
        F.coalesce("pe_number", F.lit("")).alias("pe_number"),
        F.when(none, "MANUAL_REVIEW").otherwise(F.col("program_name")).alias("program_name"),
        F.coalesce("agency", F.lit("")).alias("agency"),
        F.coalesce("budget_activity", F.lit("")).alias("budget_activity"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("match_detail", F.lit("No match found above threshold")).alias("match_detail"),
    )


def link_two_stage(
    queries: DataFrame, elements: DataFrame, fuzzy_cutoff: float = 80.0, semantic_threshold: float = 0.45, embed=hashed_embedding
) -> DataFrame:
    """The older linker: best spelling, else best vector; INVALID_INPUT for blank, MANUAL_REVIEW for unmatched queries."""
    asked = queries.select("query").distinct()
    usable = asked.where(F.trim("query") != "")
    fuzzy = cut_lineage(fuzzy_matches(usable, elements, 1, fuzzy_cutoff).select("query", "pe_id", F.round("score", 2).alias("score")))
    rest = usable.join(fuzzy, "query", "left_anti")
    semantic = semantic_matches(rest, elements, 1, semantic_threshold, embed).select("query", "pe_id", F.round("score", 3).alias("score"))
    found = (
        fuzzy.withColumn("match_strategy", F.lit("FUZZY"))
        .unionByName(semantic.withColumn("match_strategy", F.lit("SEMANTIC")))
        .join(elements.select("pe_id", "program_name"), "pe_id")
    )
    blank = F.coalesce(F.trim("query"), F.lit("")) == ""
    return asked.join(found, "query", "left").select(
        "query",
        F.col("pe_id").alias("matched_pe_id"),
        F.when(blank, "INVALID_INPUT").otherwise(F.coalesce("program_name", F.lit("MANUAL_REVIEW"))).alias("matched_name"),
        F.coalesce("match_strategy", F.lit("NONE")).alias("match_strategy"),
        F.coalesce("score", F.lit(0.0)).alias("confidence_score"),
    )


# -- queries -------------------------------------------------------------------------------------------------------------


def _stated_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The stated query set: the names of all elements whose id is divisible by 100."""
    return elements(spark, folder).where("pe_id % 100 = 0").select(F.col("program_name").alias("query"))


_TITLE_ACRONYMS = r"""(SELECT pe_id, pe_number, unnest(list_distinct(list_transform(CASE WHEN len(regexp_extract_all(program_name, '\(([A-Z][A-Z0-9\-]{1,})\)', 1)) > 0
  THEN regexp_extract_all(program_name, '\(([A-Z][A-Z0-9\-]{1,})\)', 1)
  ELSE list_filter(regexp_extract_all(program_name, '\b([A-Z][A-Z0-9]{2,})\b', 1), lambda a: a NOT IN (__)) END,
  lambda a: upper(regexp_replace(a, '[\s\-]', '', 'g'))))) AS acronym FROM elements)""".replace("__", words(X.GENERIC_CAPITALS))


@query(BASE_SQL + f"SELECT pe_id, pe_number, acronym FROM {_TITLE_ACRONYMS} WHERE acronym <> ''")
def mat01_acronym_index(spark: SparkSession, folder: str) -> DataFrame:
    """The inverted index from acronyms to elements (AGG-16, SC-S4, SC-S5)."""
    return acronym_index(elements(spark, folder))


@query(
    BASE_SQL
    + f""", ix AS (SELECT * FROM {_TITLE_ACRONYMS} WHERE acronym <> ''), k AS (SELECT DISTINCT acronym AS key FROM ix),
      v AS (SELECT key AS query, key FROM k UNION SELECT key || 'S', key || 'S' FROM k UNION SELECT left(key, len(key) - 1), left(key, len(key) - 1) FROM k WHERE len(key) > 1),
      h AS (SELECT query, pe_id, pe_number, acronym, 1.0::DOUBLE AS score FROM v JOIN ix ON acronym = key
        UNION ALL SELECT query, pe_id, pe_number, acronym, 0.9::DOUBLE FROM v JOIN ix ON starts_with(acronym, key) AND len(acronym) > len(key) AND len(acronym) - len(key) <= 2
        UNION ALL SELECT query, pe_id, pe_number, acronym, 0.85::DOUBLE FROM v JOIN ix ON starts_with(key, acronym) AND len(key) > len(acronym) AND len(key) - len(acronym) <= 2),
      b AS (SELECT *, max(score) OVER (PARTITION BY query) AS best FROM h)
      SELECT DISTINCT ON (query, pe_id) query, pe_id, pe_number, acronym, score FROM b WHERE score = best ORDER BY query, pe_id, acronym"""
)
def mat02_acronym_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Every acronym, each with a letter more and a letter less, looked up in the index (JOIN-09, JOIN-10, MAT-03, WIN-14)."""
    index = acronym_index(elements(spark, folder))
    key = F.col("acronym")
    forms = F.array(key, F.concat(key, F.lit("S")), F.left(key, F.length(key) - 1))
    lookups = index.select(F.explode(forms).alias("query")).where("query <> ''").distinct()
    lookups = lookups.select("query", F.lit(0).alias("position"), F.col("query").alias("key"))
    return acronym_matches(lookups, index)


@query()
def mat04_fuzzy_matches(spark: SparkSession, folder: str) -> DataFrame:
    return fuzzy_matches(_stated_queries(spark, folder), elements(spark, folder), 5, 55.0)


@query(
    BASE_SQL
    + """SELECT query, min(pe_id) AS pe_id, query AS program_name, 100.0::DOUBLE AS score FROM (SELECT DISTINCT program_name AS query FROM elements WHERE pe_id % 100 = 0) q
      JOIN (SELECT pe_id, program_name FROM elements WHERE NOT is_classified) e ON program_name = query WHERE trim(query) <> '' GROUP BY query"""
)
def mat05_best_fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    """The closest title of each stated query, which is one itself: its own, or the first of those equal to it (MAT-05)."""
    q = _stated_queries(spark, folder).join(elements(spark, folder).where(~F.col("is_classified")), F.col("query") == F.col("program_name"), "left_semi")
    return best_fuzzy_match(q, elements(spark, folder))


#: Free texts that no title is equal to: plain words, an acronym, misspellings, a number inside words, words of no program, blanks.
SAMPLE_QUERIES = [
    "radar for small ships",
    "LTAMD sensor",
    "hypersonc glide vehicel",
    "status of 0601102A please",
    "catering contract for visitors",
    "   ",
]


@query()
def mat10_link_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The waterfall over the stated names, numbers and free-text samples (MAT-09, WIN-01, JOIN-11)."""
    e = elements(spark, folder).where("pe_id % 100 = 0")
    sample = spark.createDataFrame([(q,) for q in SAMPLE_QUERIES], "query string")
    asked = e.select(F.explode(F.array("program_name", "pe_number")).alias("query")).unionByName(sample)
    return link_queries(asked, elements(spark, folder))


@query()
def mat12_link_two_stage(spark: SparkSession, folder: str) -> DataFrame:
    sample = spark.createDataFrame([(q,) for q in SAMPLE_QUERIES], "query string")
    return link_two_stage(_stated_queries(spark, folder).unionByName(sample), elements(spark, folder))


@query(
    BASE_SQL
    + """SELECT q.id AS row_id, e.pe_id, e.agency, row_number() OVER (PARTITION BY q.id ORDER BY e.pe_id) AS rank FROM (SELECT id, lpad(regexp_extract(u, '^[0-9]+'),
        CAST(greatest(7, len(regexp_extract(u, '^[0-9]+'))) AS INTEGER), '0') || regexp_extract(u, '^[0-9]+(.*)$', 1) AS number
        FROM (SELECT id, upper(regexp_replace(pe_number, '[^0-9A-Za-z]', '', 'g')) AS u FROM program_elements)) q JOIN elements e ON e.pe_number = q.number"""
)
def flt02_number_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Every number looked up in all elements: one row per agency and spelling (MAT-09's first stage)."""
    e = elements(spark, folder)
    asked = e.select(F.col("pe_id").alias("row_id"), "pe_number")
    place = Window.partitionBy("row_id").orderBy("pe_id")
    return asked.join(e, "pe_number").select("row_id", "pe_id", "agency", F.row_number().over(place).cast("bigint").alias("rank"))


def _abbreviation_sql() -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in X.ABBREVIATIONS.items()) + "}"


_NORMAL_SQL = (
    r"array_to_string(list_filter(regexp_split_to_array(trim(replace(regexp_replace(lower(program_name), '[^\w\s\-]', ' ', 'g'), '-', ' ')), '\s+'), lambda w: w <> '' AND w NOT IN ("
    + ", ".join(f"'{w}'" for w in X.STOP_WORDS)
    + ")), ' ')"
)


_SEARCHED = rf"""n AS (SELECT pe_id, program_name, is_classified, {_NORMAL_SQL} AS normalized FROM elements),
  x AS (SELECT *, array_to_string(list_transform(string_split(normalized, ' '), lambda w: coalesce(m[w], w)), ' ') AS expanded FROM n, (SELECT {_abbreviation_sql()} AS m)),
  s AS (SELECT pe_id, program_name, is_classified, coalesce(nullif(expanded, ''), nullif(normalized, ''), program_name) AS text FROM x),
  {hashed_vectors('a', "SELECT DISTINCT program_name AS id, text FROM s WHERE pe_id % 100 = 0 AND trim(program_name) <> ''")},
  {hashed_vectors('b', "SELECT pe_id AS id, text FROM s WHERE NOT is_classified")}, {cosines('t', 'a', 'b')}"""


def _nearest_sql(columns: str, n: int, least: float) -> str:
    return (
        BASE_SQL
        + f""", {_SEARCHED} SELECT {columns} FROM (SELECT query, other AS pe_id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, other) AS INTEGER) AS rank
      FROM t WHERE score >= {least}) r JOIN elements e USING (pe_id) WHERE rank <= {n}"""
    )


@query(_nearest_sql("query, pe_id, score, rank", 5, 0.35))
def mat06_semantic_matches(spark: SparkSession, folder: str) -> DataFrame:
    return semantic_matches(_stated_queries(spark, folder), elements(spark, folder))


@query(_nearest_sql("query, pe_id, program_name, score", 1, 0.45))
def mat07_best_semantic(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest title of each stated query (MAT-07)."""
    return best_semantic_match(_stated_queries(spark, folder), elements(spark, folder))


@query(
    BASE_SQL
    + rf""", n AS (SELECT pe_id, program_name, {_NORMAL_SQL} AS normalized FROM elements)
      SELECT pe_id, normalized, array_to_string(list_transform(string_split(normalized, ' '), lambda w: coalesce(m[w], w)), ' ') AS expanded,
        list_sort(list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(program_name, '\(([A-Z0-9][A-Z0-9\-]{{1,}})\)', 1),
          regexp_extract_all(program_name, '\b([A-Z][A-Z0-9\-]{{1,}})\b', 1)), lambda a: trim(a, '-')), lambda a: a <> ''))) AS acronyms
      FROM n, (SELECT {_abbreviation_sql()} AS m)"""
)
def scs09_processed_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Every title prepared as a query (SC-S3, SC-S6, SC-S7, SC-S9, SET-02, SC-A1)."""
    p = X.processed_query(F.col("program_name"))
    return elements(spark, folder).select("pe_id", p.alias("p")).select(
        "pe_id", "p.normalized", "p.expanded", F.array_sort("p.acronyms").alias("acronyms")
    )


@query(
    r"""SELECT id AS pe_id, array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(lower(program_name), '[!-/:-@\[-`{-~]', '', 'g')), '\s+'), lambda w: w <> '' AND w NOT IN ("""
    + ", ".join(f"'{w}'" for w in X.LEGACY_STOP_WORDS)
    + ")), ' ') AS legacy FROM program_elements"
)
def scs08_legacy_normalized(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "program_elements").select(F.col("id").alias("pe_id"), X.legacy_normalized(F.col("program_name")).alias("legacy"))


@query(
    r"""SELECT id, CASE WHEN regexp_full_match(upper(replace(trim(pe_number), ' ', '')), '[0-9]{7,9}[A-Z0-9]{0,3}') THEN upper(replace(trim(pe_number), ' ', ''))
      ELSE nullif(regexp_extract(upper(pe_number), '\b([0-9]{7,9}[A-Z0-9]{0,3})\b', 1), '') END AS detected,
      regexp_full_match(pe_number, '[0-9]{7,9}[A-Z0-9]{0,3}') AS valid FROM program_elements"""
)
def scs02_detected_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers as written: valid as they are, or detected (SC-S1, SC-S2)."""
    c = F.col("pe_number")
    return read_table(spark, folder, "program_elements").select("id", X.detected_pe_number(c).alias("detected"), c.rlike(X.PE_NUMBER).alias("valid"))
