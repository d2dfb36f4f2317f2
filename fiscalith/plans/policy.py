"""Policy prose against program elements by vectors: search, mapping, gap analysis."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fiscalith.functions.numeric import confidence_badge, cosine, rounded
from fiscalith.operators.vectors import hashed_embedding, missing_vectors, top_k_cosine
from fiscalith.plans.registry import query
from fiscalith.plans.sql_terms import cosines, hashed_vectors
from fiscalith.plans.sql_terms import rounded as sql_rounded
from fiscalith.plans.trends import elements, facts, latest_funding, wide_millions
from fiscalith.session import cut_lineage
from fiscalith.sources.tables import read_table

OVERFETCH_CHUNKS, OVERFETCH_ELEMENTS = 5, 3


def chunk_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with what is known of their document (JOIN-02)."""
    documents = read_table(spark, folder, "policy_documents").select(F.col("id").alias("document_id"), "doc_type", "doc_year", "fiscal_year")
    chunks = read_table(spark, folder, "policy_chunks").select(
        F.col("id").alias("chunk_id"), "document_id", "chunk_index", "section_id", "section_title", "text"
    )
    return chunks.join(documents, "document_id")


def search_chunks(
    hits: DataFrame,
    metadata: DataFrame,
    top_n: int = 10,
    threshold: float = 0.30,
    doc_types: Sequence[str] = (),
    years: Sequence[int] = (),
    fiscal_years: Sequence[int] = (),
) -> DataFrame:
    """The ``top_n`` hits of each query that pass the filters, among the five times as many it fetched.

    ``hits`` has query, chunk_id, score and rank of at least ``5 * top_n`` a query. The filters come after the over-fetch, so a query can get fewer
    than ``top_n`` though more would pass: filter the corpus beforehand to avoid that.
    """
    rows = hits.where((F.col("rank") <= OVERFETCH_CHUNKS * top_n) & (F.col("score") >= threshold)).join(metadata, "chunk_id")
    for column, allowed in (("doc_type", doc_types), ("doc_year", years), ("fiscal_year", fiscal_years)):
        if allowed:
            rows = rows.where(F.col(column).isin(*allowed))
    place = Window.partitionBy("query").orderBy(F.desc("score"), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top_n).select(
        "query", "rank", "chunk_id", "document_id", "doc_type", "doc_year", "fiscal_year", "section_id", "section_title",
        F.substring("text", 1, 400).alias("text"), rounded(F.col("score"), 4).alias("score"),
    )


def policy_contexts(found: DataFrame, n: int = 3) -> DataFrame:
    """``query`` and its first ``n`` hits as one line (AGG-14)."""
    label = F.concat(
        F.lit("["), "doc_type", F.lit(" "), F.col("doc_year").cast("string"), F.lit(" "), F.coalesce("section_title", F.lit("")), F.lit("]")
    )
    some = found.where(F.col("rank") <= n).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", label.alias("label")))).alias("__l"))
    return some.select("query", F.array_join(F.transform("__l", lambda x: x["label"]), "; ").alias("policy_context"))


def policy_to_elements(
    element_hits: DataFrame,
    chunk_hits: DataFrame,
    metadata: DataFrame,
    elements: DataFrame,
    facts: DataFrame,
    top_n: int = 10,
    threshold: float = 0.35,
    doc_types: Sequence[str] = (),
    years: Sequence[int] = (),
    chunk_threshold: float | None = None,
) -> DataFrame:
    """Elements of each policy query with the policy's context, from documents of ``doc_types`` and ``years`` alone, and their latest request.

    ``chunk_threshold`` is that of the context, where it differs from the elements'. The filters choose the context; elements have no type or year.
    """
    place = Window.partitionBy("query").orderBy(F.desc("score"), "pe_id")
    best = element_hits.where((F.col("rank") <= OVERFETCH_ELEMENTS * top_n) & (F.col("score") >= threshold))
    best = best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top_n)
    least = threshold if chunk_threshold is None else chunk_threshold
    contexts = policy_contexts(search_chunks(chunk_hits, metadata, 5, least, doc_types, years))
    return (
        best.join(elements.drop("is_classified"), "pe_id")
        .join(contexts, "query", "left")
        .join(latest_funding(facts), "pe_id", "left")
        .select(
            "query", "pe_id", "pe_number", "program_name", "agency", "budget_activity", rounded(F.col("score"), 4).alias("relevance_score"),
            F.coalesce("policy_context", F.lit("")).alias("policy_context"), "latest_fy", "latest_by_request_m", F.coalesce("trend", F.lit("N/A")).alias("trend"),
        )
    )


def gap_analysis(
    element_hits: DataFrame,
    chunk_hits: DataFrame,
    metadata: DataFrame,
    elements: DataFrame,
    facts: DataFrame,
    first: int,
    last: int,
    doc_types: Sequence[str] = (),
    top_n: int = 10,
    least: float = 0.40,
    chunk_threshold: float = 0.35,
) -> DataFrame:
    """Relevant elements of each policy query with their yearly requests in millions and the trend; both null for one without any.

    Of ``doc_types`` the first filters the context.
    """
    linked = policy_to_elements(element_hits, chunk_hits, metadata, elements, facts, top_n, least, doc_types[:1], chunk_threshold=chunk_threshold)
    wide = wide_millions(facts, first, last)
    return linked.where(F.col("relevance_score") >= least).join(wide, "pe_id", "left").drop("latest_fy", "latest_by_request_m", "trend")


def element_to_policy(
    asked: DataFrame,
    elements: DataFrame,
    metadata: DataFrame,
    top_n: int = 10,
    threshold: float = 0.30,
    doc_types: Sequence[str] = (),
    embed: Callable[[Column], Column] = hashed_embedding,
) -> DataFrame:
    """Policy passages for each identifier in ``query``: that of an element's number is searched by the name of its first element, any other as it is."""
    names = elements.groupBy("pe_number").agg(F.min_by("program_name", "pe_id").alias("__name"))
    queries = asked.select("query").where(F.trim("query") != "").distinct()
    texts = queries.join(names, queries.query == names.pe_number, "left").select("query", embed(F.coalesce("__name", "query")).alias("__q"))
    corpus = metadata.where(F.col("text").isNotNull()).select("chunk_id", embed(F.col("text")).alias("__v"))
    hits = top_k_cosine(texts, "query", "__q", corpus, "chunk_id", "__v", OVERFETCH_CHUNKS * top_n)
    return search_chunks(hits, metadata, top_n, threshold, doc_types)


#: Passages that stand for a year whose passages have no titles.
UNTITLED = 20


def section_representatives(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each section title among the chunks of equal ``keys`` the first chunk in order: the keys, ``section``, ``chunk_id`` and ``text``.

    Where no chunk of the keys has a title, the first ``UNTITLED`` chunks stand for it, each by itself.
    """
    title = F.trim("section_title")
    order = F.struct("chunk_index", "chunk_id")
    named = (
        chunks.where(title != "")
        .groupBy(*keys, title.alias("section"))
        .agg(F.min(order).alias("__at"), F.min_by("text", order).alias("text"))
        .select(*keys, "section", F.col("__at.chunk_id").alias("chunk_id"), "text")
    )
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("chunk_index", "chunk_id"))
    untitled = chunks.join(named.select(*keys).distinct(), list(keys), "left_anti").withColumn("__n", place).where(F.col("__n") <= UNTITLED)
    return named.unionByName(untitled.select(*keys, F.coalesce("section_title", F.lit("")).alias("section"), "chunk_id", "text"))


def section_mapping(
    metadata: DataFrame,
    elements: DataFrame,
    doc_type: str = "NDS",
    years: Sequence[int] = (),
    top_n: int = 5,
    threshold: float = 0.35,
    embed: Callable[[Column], Column] = hashed_embedding,
) -> DataFrame:
    """The elements nearest to each section of the documents of a type, by year and section, the most relevant first.

    Sections are searched by their title and the first 300 characters of their first passage; ``years`` limits the documents.
    """
    chunks = metadata.where(F.col("doc_type") == doc_type)
    if years:
        chunks = chunks.where(F.col("doc_year").isin(*years))
    sections = section_representatives(chunks, ["doc_year"])
    text = F.concat("section", F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, 300))
    known = elements.where(~F.col("is_classified"))
    corpus = known.select("pe_id", embed(F.coalesce("program_name", F.lit(""))).alias("__v"))
    top = top_k_cosine(sections.select("chunk_id", embed(text).alias("__q")), "chunk_id", "__q", corpus, "pe_id", "__v", top_n, threshold)
    rows = top.join(sections.select("chunk_id", "doc_year", "section"), "chunk_id").join(known, "pe_id")
    return rows.select(
        F.col("doc_year").alias("nds_year"), F.substring("section", 1, 200).alias("nds_section"), "pe_id", "pe_number", "program_name", "agency",
        "budget_activity", rounded(F.col("score"), 4).alias("relevance_score"),
    ).orderBy("nds_year", "nds_section", F.desc("relevance_score"), "pe_id")


# -- queries -------------------------------------------------------------------------------------------------------------

# The driver's vectors stand for both corpora: their ids are taken as ids of chunks and of elements.


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "embeddings")


def _stated(spark: SparkSession, folder: str) -> DataFrame:
    """The stated query set: vectors whose id is divisible by 100."""
    return _vectors(spark, folder).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))


def _top(spark: SparkSession, folder: str, name: str, k: int, threshold: float = -1.0) -> DataFrame:
    corpus = _vectors(spark, folder).select(F.col("vec_id").alias(name), "embedding")
    return top_k_cosine(_stated(spark, folder), "query", "q", corpus, name, "embedding", k, threshold)


_COS = """round(list_sum(list_transform(range(1, 65), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(c.embedding[i] AS DOUBLE)))
  / sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) / sqrt(list_sum(list_transform(c.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6)"""
_TOP = f"""top AS (SELECT query, other, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, other) AS rank FROM (
  SELECT q.vec_id AS query, c.vec_id AS other, {_COS} AS score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0))"""


@query(f"WITH {_TOP} SELECT query, other AS vec_id, score, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= 10")
def top01_vector_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """Exact cosine top ten (JOIN-12, MAT-06 on given vectors)."""
    return _top(spark, folder, "vec_id", 10)


@query(
    f"""WITH {_TOP}, h AS (SELECT * FROM top WHERE rank <= 50 AND score >= 0.0),
      m AS (SELECT c.id AS chunk_id, c.document_id, d.doc_type, d.doc_year, d.fiscal_year, c.section_id, c.section_title, substr(c.text, 1, 400) AS text
        FROM policy_chunks c JOIN policy_documents d ON d.id = c.document_id)
      SELECT * FROM (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, m.*, CAST(round(CAST(score AS DECIMAL(28,8)), 4) AS DOUBLE) AS score
        FROM h JOIN m ON m.chunk_id = h.other WHERE doc_type IN ('NDAA', 'NDS')) WHERE rank <= 10"""
)
def ana06_policy_search(spark: SparkSession, folder: str) -> DataFrame:
    """Search with filters after the over-fetch (FLT-10, FLT-11, TOP-02, ANA-05, ANA-07)."""
    return search_chunks(_top(spark, folder, "chunk_id", 50), chunk_metadata(spark, folder), 10, 0.0, ["NDAA", "NDS"])


_LATEST = """l AS (SELECT pe_id, max(fiscal_year) AS latest_fy, arg_max(amount, (fiscal_year, id)) AS hi, arg_min(amount, (fiscal_year, id)) AS lo,
    count(*) AS n FROM facts WHERE funding_type = 'BY Request' GROUP BY pe_id)"""


def to_elements_sql(documents: str) -> str:
    """CTEs of the elements (``b``) and contexts (``x``) of each query; ``documents`` is what must hold for those of the context."""
    return f"""{_TOP}, b AS (SELECT query, other AS pe_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, other) AS n
    FROM top WHERE rank <= 30 AND score >= 0.0) WHERE n <= 10),
  f AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, other) AS n, '[' || doc_type || ' ' || doc_year || ' ' || coalesce(section_title, '') || ']' AS label
    FROM top JOIN policy_chunks c ON c.id = other JOIN policy_documents d ON d.id = c.document_id WHERE rank <= 25 AND score >= 0.0 AND {documents}),
  x AS (SELECT query, string_agg(label, '; ' ORDER BY n) AS policy_context FROM f WHERE n <= 3 GROUP BY query), {_LATEST}"""


def _base() -> str:
    from fiscalith.plans.trends import BASE_SQL

    return BASE_SQL


@query(
    _base()
    + f""", {to_elements_sql("doc_type IN ('NDAA', 'NDS') AND doc_year BETWEEN 2005 AND 2019")} SELECT b.query, b.pe_id, e.pe_number, e.program_name, e.agency, e.budget_activity, CAST(round(CAST(score AS DECIMAL(28,8)), 4) AS DOUBLE) AS relevance_score,
      coalesce(policy_context, '') AS policy_context, latest_fy, CAST(round(CAST(hi / 1000 AS DECIMAL(28,8)), 2) AS DOUBLE) AS latest_by_request_m,
      CASE WHEN n IS NULL THEN 'N/A' WHEN n = 1 THEN '→' WHEN hi > lo * 1.05 THEN '↑' WHEN hi < lo * 0.95 THEN '↓' ELSE '→' END AS trend
      FROM b JOIN elements e USING (pe_id) LEFT JOIN x ON x.query = b.query LEFT JOIN l ON l.pe_id = b.pe_id"""
)
def ana08_policy_to_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Elements by policy query with context and latest funding (AGG-14, JOIN-04)."""
    hits = cut_lineage(_top(spark, folder, "other", 30))  # one search serves both
    return policy_to_elements(
        hits.withColumnRenamed("other", "pe_id"), hits.withColumnRenamed("other", "chunk_id"), chunk_metadata(spark, folder),
        elements(spark, folder), facts(spark, folder), 10, 0.0, ["NDAA", "NDS"], range(2005, 2020),
    )


@query()
def ana10_gap_analysis(spark: SparkSession, folder: str) -> DataFrame:
    """Elements by policy query with yearly requests and trend, context from one type of document (JOIN-05, PVT-01, WIN-11)."""
    hits = cut_lineage(_top(spark, folder, "other", 30))
    return gap_analysis(
        hits.withColumnRenamed("other", "pe_id"), hits.withColumnRenamed("other", "chunk_id"), chunk_metadata(spark, folder),
        elements(spark, folder), facts(spark, folder), 2018, 2026, ["NDAA", "NDS"], 10, 0.0, 0.0,
    )


@query(
    """WITH c AS (SELECT *, trim(section_title) AS section FROM policy_chunks) SELECT document_id, section, arg_min(id, (chunk_index, id)) AS chunk_id,
      min_by([text], (chunk_index, id))[1] AS text FROM c WHERE section <> '' GROUP BY ALL
      UNION ALL SELECT document_id, section, id, text FROM (SELECT document_id, coalesce(section_title, '') AS section, id, text, row_number() OVER (PARTITION BY document_id
        ORDER BY chunk_index, id) AS n FROM c WHERE document_id NOT IN (SELECT document_id FROM c WHERE section <> '')) WHERE n <= 20"""
)
def win03_section_representatives(spark: SparkSession, folder: str) -> DataFrame:
    """The first passage of each section of each document; the first of those without any section (WIN-03)."""
    return section_representatives(read_table(spark, folder, "policy_chunks").withColumnRenamed("id", "chunk_id"), ["document_id"])


_META_SQL = """m AS (SELECT c.id AS chunk_id, c.document_id, c.chunk_index, d.doc_type, d.doc_year, d.fiscal_year, c.section_id, c.section_title, c.text
  FROM policy_chunks c JOIN policy_documents d ON d.id = c.document_id)"""


@query(
    _base()
    + f""", {_META_SQL}, n AS (SELECT *, trim(section_title) AS section FROM m WHERE doc_type = 'NDS'),
      s AS (SELECT doc_year, section, arg_min(chunk_id, (chunk_index, chunk_id)) AS id, min_by([text], (chunk_index, chunk_id))[1] AS text FROM n WHERE section <> '' GROUP BY ALL
        UNION ALL SELECT doc_year, section, chunk_id, text FROM (SELECT doc_year, coalesce(section_title, '') AS section, chunk_id, text, row_number() OVER (PARTITION BY doc_year
          ORDER BY chunk_index, chunk_id) AS k FROM n WHERE doc_year NOT IN (SELECT doc_year FROM n WHERE section <> '')) WHERE k <= 20),
      {hashed_vectors('a', "SELECT id, section || ': ' || substr(coalesce(text, ''), 1, 300) AS text FROM s")},
      {hashed_vectors('b', "SELECT pe_id AS id, program_name AS text FROM elements WHERE NOT is_classified")}, {cosines('t', 'a', 'b')}
      SELECT doc_year AS nds_year, substr(section, 1, 200) AS nds_section, pe_id, pe_number, program_name, agency, budget_activity, {sql_rounded('score', 4)} AS relevance_score
      FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, other) AS rank FROM t WHERE score >= 0.2) t JOIN s ON s.id = t.query JOIN elements e ON e.pe_id = t.other WHERE rank <= 5"""
)
def ana11_section_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """The elements nearest to the sections of the defense strategies, of all years (ANA-11, SRT-03, WIN-03, TOP-04)."""
    return section_mapping(chunk_metadata(spark, folder), elements(spark, folder), threshold=0.2)


@query(
    _base()
    + f""", {_META_SQL}, q AS (SELECT DISTINCT pe_number AS query FROM elements WHERE pe_id % 100 = 0),
      f AS (SELECT pe_number, arg_min(program_name, pe_id) AS name FROM elements GROUP BY pe_number),
      {hashed_vectors('a', "SELECT query AS id, coalesce(name, query) AS text FROM q LEFT JOIN f ON pe_number = query")},
      {hashed_vectors('b', "SELECT chunk_id AS id, text FROM m WHERE text IS NOT NULL")}, {cosines('t', 'a', 'b')},
      h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, other) AS n FROM t) WHERE n <= 50 AND score >= 0.05)
      SELECT * EXCLUDE (chunk_index) REPLACE (substr(text, 1, 400) AS text) FROM (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, m.*,
        {sql_rounded('score', 4)} AS score FROM h JOIN m ON chunk_id = other WHERE doc_type IN ('NDAA')) WHERE rank <= 10"""
)
def ana09_element_to_policy(spark: SparkSession, folder: str) -> DataFrame:
    """Policy passages for elements given by number: the name stands in for a number that is known (ANA-09, FLT-03, MAT-08)."""
    e = elements(spark, folder)
    asked = e.where("pe_id % 100 = 0").select(F.col("pe_number").alias("query"))
    return element_to_policy(asked, e, chunk_metadata(spark, folder), 10, 0.05, ["NDAA"])


@query(
    """SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE)))
      / sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) / sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS score,
      CASE WHEN score >= 0.55 THEN 'HIGH' WHEN score >= 0.40 THEN 'MEDIUM' ELSE 'LOW' END AS badge
      FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) b"""
)
def scm10_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """One query vector against all, as a pure expression, with the confidence badge (SC-M9, SC-M10)."""
    v = _vectors(spark, folder)
    # One row: the vector of the smallest id.
    one = v.agg(F.min_by("embedding", "vec_id").alias("q"))
    scored = v.join(F.broadcast(one)).select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    return scored.withColumn("badge", confidence_badge(F.col("score"), 0.55, 0.40))


@query(
    """SELECT label, count(*) AS n, CAST(round(avg(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 4) AS DOUBLE) AS mean_norm
      FROM embeddings GROUP BY label"""
)
def src29_vector_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Cached vectors by label: how many, and that they are of length one."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return _vectors(spark, folder).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(norm), 4).alias("mean_norm"))


@query("SELECT id AS chunk_id, text FROM policy_chunks WHERE text IS NOT NULL AND id NOT IN (SELECT vec_id FROM embeddings)")
def src29_missing_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks whose vectors have yet to be computed: an anti join on the cache (JOIN-08)."""
    chunks = read_table(spark, folder, "policy_chunks").select(F.col("id").alias("chunk_id"), "text")
    return missing_vectors(chunks, "chunk_id", "text", _vectors(spark, folder).withColumnRenamed("vec_id", "chunk_id"))
