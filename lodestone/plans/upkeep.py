"""Further queries: state and its writers, navigation, standing, memory, pictures, queue, languages, extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import gate as G
from lodestone.functions import text as X
from lodestone.operators import authority, conflict, graph, jobs, language, memory, retrieval, state, structure, telemetry, units, vision, wiki
from lodestone.plans import sql as S
from lodestone.plans.catalogue import _CONTRARY, _EXCHANGES, _PAGES, _TERMS, K, _candidates, _hits, _links, _log, _manifest, _tiers, _was, _wiki_units, conflict_pairs, last_sentence, query, questions, table
from lodestone.plans.catalogue import _COST
from lodestone.sources import extract
from lodestone.sources.shared import cut, few

# scalars


@query("SELECT DISTINCT url, CASE WHEN s = '' THEN 'page' ELSE s END AS slug FROM (SELECT url, trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '-') AS s FROM pages)")
def page_slugs(spark, d):
    return table(spark, d, "pages").select("url", X.slug(F.col("url")).alias("slug")).distinct()


@query(f"""
SELECT DISTINCT term, CASE WHEN length(term) >= 4 AND right(term, 1) = 's' AND substring(term, length(term) - 1, 1) NOT IN ('s', 'i', 'u') THEN left(term, length(term) - 1) ELSE term END AS folded
FROM (SELECT unnest({S.ascii_tokens("text")}) AS term FROM documents)""")
def folded_terms(spark, d):
    terms = table(spark, d, "documents").select(F.explode(X.tokens(F.col("text"))).alias("term")).distinct()
    return terms.select("term", X.fold_plural(F.col("term")).alias("folded"))


@query("""
SELECT DISTINCT raw, rtrim(rtrim(replace(raw, ',', ''), '0'), '.') AS number FROM (SELECT format('{:,}', o_orderkey) || '.' || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') AS raw FROM orders)""")
def normal_numbers(spark, d):
    raw = F.concat(F.format_number("o_orderkey", 0), F.lit("."), F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"))
    return table(spark, d, "orders").select(raw.alias("raw")).distinct().select("raw", X.normal_number(F.col("raw")).alias("number"))


@query(f"""
SELECT question_id, doc_id, len(list_intersect({S.content(S.ascii_tokens("question"))}, {S.content(S.ascii_tokens("text"))})) > 0 AS relevant
FROM {S.bm25(S.questions(), K)} JOIN {S.questions()} USING (question_id) JOIN documents USING (doc_id)""")
def relevance_first(spark, d):
    """Relevance by the ASCII tokenizer."""
    rows = few(_candidates(spark, d).join(questions(spark, d), "question_id")).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("question_id", "doc_id", G.relevant(X.tokens(F.col("question")), X.tokens(F.col("text"))).alias("relevant"))


# more signals


def embedded(rows: DataFrame, key: str, text: str) -> DataFrame:
    return retrieval.embedded(rows.select(F.col(key).alias("id"), F.col(text).alias("text")))


def _embedding(rows: str) -> str:
    """(id, bucket, w) of rows (id, text)."""
    return f"""(SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS w FROM (SELECT id, bucket, CAST(count(*) AS DOUBLE) AS n FROM
  (SELECT id, CAST(('0x' || right(sha1(t), 2)) AS INTEGER) % {retrieval.DIM} AS bucket FROM (SELECT id, unnest({S.tokens("text")}) AS t FROM {rows})) GROUP BY ALL))"""


@query(f"SELECT id AS doc_id, bucket, round(w, 6) AS weight FROM {_embedding('(SELECT doc_id AS id, text FROM documents)')}")
def hashing_embedder(spark, d):
    v = embedded(table(spark, d, "documents"), "doc_id", "text")
    each = v.select(F.col("id").alias("doc_id"), F.posexplode("v").alias("bucket", "w")).filter("w > 0")
    return each.select("doc_id", "bucket", F.round("w", 6).alias("weight"))


_CORPUS_ASK = f"""
WITH q AS (SELECT * FROM {_embedding("(SELECT question_id AS id, question AS text FROM " + S.questions() + ")")}), v AS (SELECT * FROM {_embedding("(SELECT doc_id AS id, text FROM documents)")}),
s AS (SELECT q.id AS question_id, v.id AS doc_id, round(1 - sum(q.w * v.w), 6) AS distance FROM q JOIN v USING (bucket) GROUP BY ALL),
every AS (SELECT question_id, doc_id, CASE WHEN distance = 0 THEN 0.0::DOUBLE ELSE coalesce(distance, 1.0::DOUBLE) END AS distance FROM (SELECT DISTINCT id AS question_id FROM q) CROSS JOIN (SELECT DISTINCT id AS doc_id FROM v) LEFT JOIN s USING (question_id, doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, doc_id) AS rank FROM every)
SELECT question_id, doc_id, distance, rank FROM r WHERE rank <= {K}"""


@query(_CORPUS_ASK)
def corpus_ask(spark, d):
    """Documents and questions embedded, the nearest by cosine. The documents' vectors are cut: the search counts them and then reads them."""
    docs = cut(embedded(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("vec_id"), F.col("v").alias("embedding")))
    q = embedded(questions(spark, d), "question_id", "question").select(F.col("id").alias("question_id"), F.col("v").alias("q"))
    return retrieval.vector_top(q, docs, K, "cosine", retrieval.DIM).select("question_id", F.col("vec_id").alias("doc_id"), "distance", "rank")


@query(f"SELECT question_id, round(max(score) - min(score), 6) AS spread FROM {S.bm25(S.questions(), K)} GROUP BY question_id")
def score_spread(spark, d):
    return retrieval.spread(_candidates(spark, d))


@query(f"""
WITH {_EXCHANGES}, q AS (SELECT conv_id, arg_max(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY conv_id),
h AS (SELECT conv_id, idx, question, answer, len(list_intersect({S.content(S.ascii_tokens("query"))}, {S.ascii_tokens("question || ' ' || answer")})) AS hits FROM x JOIN q USING (conv_id)),
k AS (SELECT *, max(hits) OVER (PARTITION BY conv_id) AS most FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY hits DESC, idx DESC) AS rank FROM k WHERE hits > 0 OR most = 0),
c AS (SELECT conv_id, string_agg(question || ' ' || answer, ' ' ORDER BY rank) AS c FROM r WHERE rank <= {memory.RECALL} GROUP BY conv_id)
SELECT conv_id, CASE WHEN c IS NULL THEN query ELSE c || ' ' || query END AS query FROM q LEFT JOIN c USING (conv_id)""")
def query_expansion(spark, d):
    conv = table(spark, d, "conversations")
    q = conv.filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("query"))
    return memory.expanded(q, memory.exchanges(conv))


@query("""
WITH u AS (SELECT DISTINCT l_orderkey || '::' || l_linenumber AS eu_id, CAST(l_orderkey AS VARCHAR) AS block_ref FROM lineitem),
refs AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS ref FROM lineitem UNION SELECT eu_id FROM u WHERE block_ref IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P'))
SELECT ref, ref AS eu_id FROM refs WHERE ref IN (SELECT eu_id FROM u) UNION ALL SELECT ref, eu_id FROM refs JOIN u ON block_ref = ref WHERE ref NOT IN (SELECT eu_id FROM u)""")
def block_refs(spark, d):
    """An order is a block that was cut in its lines."""
    u = table(spark, d, "lineitem").select(F.concat_ws("::", "l_orderkey", "l_linenumber").alias("eu_id"), F.col("l_orderkey").cast("string").alias("block_ref")).distinct()
    some = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").cast("string").alias("block_ref"))
    refs = u.select(F.col("block_ref").alias("ref")).union(u.join(some, "block_ref", "left_semi").select("eu_id")).distinct()
    return structure.resolve(refs, u)


# standing


_ORDER = ["draft", "notice", "statute"]
_META = "CASE WHEN quality IS NULL THEN '' ELSE '{' || '\"kind\":\"' || CASE quality WHEN 1 THEN 'statute' ELSE 'draft' END || '\",\"lang\":\"' || lang || '\"}' END"


@query(f"""
SELECT doc_id, {_META} AS meta, CASE quality WHEN 1 THEN 'statute' WHEN 0 THEN 'draft' ELSE 'unranked' END AS tier, CAST(CASE quality WHEN 1 THEN 2 WHEN 0 THEN 0 ELSE -1 END AS INTEGER) AS rank
FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)""")
def authority_meta(spark, d):
    """Labels written as metadata, and the tier read from it again."""
    rows = table(spark, d, "documents").join(_tiers(spark, d), "doc_id", "left")
    kind = F.when(F.col("tier_rank") == 1, "statute").otherwise("draft")
    rows = rows.withColumn("meta", F.when(F.col("tier_rank").isNull(), "").otherwise(authority.encode(kind=kind, lang=F.col("lang"))))
    rows = rows.withColumn("t", authority.tier_of(F.col("meta"), "kind", _ORDER))
    return rows.select("doc_id", "meta", F.col("t.name").alias("tier"), F.col("t.rank").alias("rank"))


@query(f"""
SELECT question_id, min(coalesce(tier, -1)) AS tier FROM {S.bm25(S.questions(), K)} LEFT JOIN (SELECT doc_id, max(quality) AS tier FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY question_id""")
def weakest_tier(spark, d):
    return authority.weakest(authority.ranked(_candidates(spark, d), _tiers(spark, d)))


@query(f"""SELECT "group", format('{{}}: {{}} vs {{}}', rule, "left", "right") AS line FROM {_CONTRARY}""")
def conflict_lines(spark, d):
    return conflict.describe(conflict_pairs(spark, d))


# state


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Three versions of each document: German ones come back to the first text, English ones stay with the third, others never change."""
    docs = table(spark, d, "documents")
    text = F.when((F.col("lang") == "de") & (F.col("seq") == 1), F.concat("text", F.lit(" v1"))).when((F.col("lang") == "en") & (F.col("seq") > 0), F.concat(F.col("text"), F.lit(" v"), F.col("seq").cast("string"))).otherwise(F.col("text"))
    return docs.withColumn("seq", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select("doc_id", "seq", state.checksum(text).alias("checksum"))


_HISTORY = """(SELECT doc_id, CASE lang WHEN 'en' THEN sha256(text || ' v2') ELSE sha256(text) END AS checksum,
  CASE lang WHEN 'en' THEN list_sort([sha256(text), sha256(text || ' v1')]) WHEN 'de' THEN [sha256(text || ' v1')] ELSE [] END AS retired FROM documents)"""


@query(f"SELECT doc_id, checksum, array_to_string(retired, ',') AS retired FROM {_HISTORY}")
def record_history(spark, d):
    return state.history(_versions(spark, d)).select("doc_id", "checksum", F.array_join("retired", ",").alias("retired"))


@query(f"SELECT doc_id, checksum FROM {_HISTORY} h WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src0')")
def forget_documents(spark, d):
    gone = table(spark, d, "documents").filter("source = 'src0'").select("doc_id")
    return state.forget(state.history(_versions(spark, d)), gone).select("doc_id", "checksum")


@query("SELECT lang, source, CASE lang WHEN 'en' THEN 2 WHEN 'de' THEN 1 END AS version FROM (SELECT DISTINCT lang, source FROM documents) WHERE lang <> 'en'")
def tokenizer_staleness(spark, d):
    """English partitions have the present version, German ones the first, others none."""
    parts = table(spark, d, "documents").select("lang", "source").distinct()
    return state.stale(parts.withColumn("version", F.when(F.col("lang") == "en", 2).when(F.col("lang") == "de", 1)))


@query("SELECT doc_id, CASE WHEN lang = 'fr' THEN sha256(text || ' v0') ELSE sha256(text) END AS checksum FROM documents")
def enumerate_index(spark, d):
    """The manifest lacks the French documents, of which the store holds another version."""
    held = F.when(F.col("lang") == "fr", F.concat("text", F.lit(" v0"))).otherwise(F.col("text"))
    return state.indexed(_manifest(spark, d).filter("lang <> 'fr'"), _manifest(spark, d, held))


@query(f"""
WITH h AS {_HISTORY}, g AS (SELECT doc_id FROM documents WHERE source = 'src0'), l AS (SELECT * FROM h WHERE doc_id NOT IN (SELECT doc_id FROM g)),
dead AS (SELECT DISTINCT c FROM (SELECT unnest(list_append(retired, checksum)) AS c FROM h WHERE doc_id IN (SELECT doc_id FROM g)) WHERE c NOT IN (SELECT checksum FROM l)),
b AS (SELECT DISTINCT c FROM (SELECT unnest(list_append(retired, checksum)) AS c FROM h))
SELECT 'units' AS layer, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g)
UNION ALL SELECT 'terms', count(*) FROM (SELECT doc_id, unnest({_TERMS}) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g))
UNION ALL SELECT 'blobs', count(*) FROM b WHERE c NOT IN (SELECT c FROM dead)
UNION ALL SELECT 'manifest', count(*) FROM l""")
def revoke_cascade(spark, d):
    """What is left of each layer once a source is revoked; blobs of all versions that its documents ever had go, unless another has them now."""
    docs = table(spark, d, "documents")
    manifest = state.history(_versions(spark, d))
    layers = {
        "units": docs.select("doc_id"),
        "terms": graph.unit_terms(docs.select(F.col("doc_id").alias("unit"), "text")).withColumnRenamed("unit", "doc_id"),
        "blobs": _versions(spark, d).select("checksum").distinct(),
    }
    left = state.cascade(layers, manifest, docs.filter("source = 'src0'"))
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("layer"), "n") for k, df in left.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN sha256(text || ' v0') ELSE sha256(text) END AS checksum FROM documents WHERE lang NOT IN ('es', 'fr')")
def remediate(spark, d):
    """The index holds French documents that aren't declared, lacks the Spanish ones and holds others' text for the English: only the first go."""
    index = _manifest(spark, d, _was()).filter("lang <> 'es'").select("doc_id", "checksum")
    declared = _manifest(spark, d).filter("lang <> 'fr'").select("doc_id", "checksum", F.lit(True).alias("current"))
    return state.forget(index, state.orphans(state.reconcile(index, declared)))


@query("SELECT DISTINCT 'raw/lang=' || lang || '/source=' || source AS prefix FROM documents")
def partition_paths(spark, d):
    return table(spark, d, "documents").select(state.layer_prefix("raw", ["lang", "source"]).alias("prefix")).distinct()


def _stamps(spark: SparkSession, d: str) -> DataFrame:
    """English documents have an older chunker, German ones no stamp of pictures."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "lang")
    rows = docs.withColumn("stage", F.explode(F.array(*[F.lit(s) for s in state.STAGES])))
    rows = rows.filter("NOT (lang = 'de' AND stage = 'vision')")
    return rows.select("document_id", "stage", F.when((F.col("lang") == "en") & (F.col("stage") == "chunker"), "1").otherwise("2").alias("version"))


_DOWN = {"en": ["eu_chunk", "embedding", "structure", "graph", "community_summary"], "de": ["vision", "eu_chunk", "embedding", "structure", "graph", "community_summary"]}
_CHANGED = {"en": "eu_chunk", "de": "vision"}


@query(" UNION ALL ".join(f"SELECT doc_id AS document_id, '{v}' AS layer FROM documents WHERE lang = '{k}'" for k, v in _CHANGED.items()))
def changed_stages(spark, d):
    return state.changed_stages(dict.fromkeys(state.STAGES, "2"), _stamps(spark, d))


@query(" UNION ALL ".join(f"SELECT doc_id AS document_id, unnest({v}) AS layer FROM documents WHERE lang = '{k}'" for k, v in _DOWN.items()))
def rebuild_layers(spark, d):
    return state.rebuild_layers(dict.fromkeys(state.STAGES, "2"), _stamps(spark, d))


# wiki and graph writers


@query(f"WITH {_PAGES} SELECT page_id, summary, len(keywords) AS n_keywords, coalesce(lead(page_id) OVER (ORDER BY page_id), 'none') AS links FROM pages")
def wiki_light_index(spark, d):
    page = wiki.pages(_wiki_units(spark, d))
    light = wiki.light(page, _links(page.select("page_id")))
    return light.select("page_id", "summary", F.size("keywords").cast("bigint").alias("n_keywords"), F.array_join("links", ",").alias("links"))


@query(f"WITH {_PAGES} SELECT page_id, CASE WHEN page_id = 'src1' THEN 'old' ELSE page_id END AS title, n_units FROM pages WHERE page_id <> 'src2'")
def wiki_upsert_remove(spark, d):
    """All pages are old but for those made anew; one is not, one is removed."""
    u = _wiki_units(spark, d)
    old = wiki.pages(u).withColumn("title", F.lit("old"))
    page = wiki.integrate(old, u.filter("page_id <> 'src1'"))
    return wiki.remove(page, spark.createDataFrame([("src2",), ("absent",)], "page_id string")).select("page_id", "title", "n_units")


@query("""
WITH p AS (SELECT source AS page_id, max(doc_id) AS last FROM documents GROUP BY source)
SELECT page_id, 'T ' || page_id AS title, 'a' AS link, CAST(last AS VARCHAR) AS refs FROM p WHERE page_id <> 'src3'""")
def wiki_sanitiser(spark, d):
    """A model's pages: titles with blanks, one without, links in brackets, a reference to the last document of the source and to one that doesn't exist."""
    docs = table(spark, d, "documents")
    said = docs.groupBy(F.col("source").alias("page_id")).agg(F.max("doc_id").alias("last"))
    title = F.when(F.col("page_id") == "src3", " ").otherwise(F.concat(F.lit(" T "), F.col("page_id")))
    said = said.select("page_id", title.alias("title"), F.lit("s").alias("summary"), F.array(F.lit("k")).alias("keywords"), F.array(F.lit("[[a]]")).alias("links"), F.array(F.col("last").cast("string"), F.lit("no such")).alias("refs"))
    kept = wiki.sane(said, docs.select(F.col("doc_id").alias("unit")))
    return kept.select("page_id", "title", F.array_join("links", ",").alias("link"), F.array_join("refs", ",").alias("refs"))


@query("""
WITH n AS (SELECT n_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA')
SELECT 'node:' || lower(a.n_name) AS source, 'node:' || lower(b.n_name) AS target, CAST(greatest(b.n_nationkey - 5, 1) AS BIGINT) AS weight, 'near' AS relation
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey WHERE a.n_name IN (SELECT label FROM n) AND b.n_name IN (SELECT label FROM n)""")
def graph_sanitiser(spark, d):
    """Nations as a model's entities, those of a region related; the units of one region don't exist, some weights are too low."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    known = n.join(r.filter("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("unit"))
    entities = n.select(F.concat(F.lit(" "), F.col("n_name")).alias("label"), F.array(F.col("n_nationkey").cast("string"), F.lit("none")).alias("refs"))
    a, b = n.select(F.col("n_name").alias("source"), F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("x")), n.select(F.col("n_name").alias("target"), F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("y"))
    relations = a.join(b, "g").filter("x < y").select("source", "target", (F.col("y") - 5).alias("weight"), F.lit(" near ").alias("relation"))
    return graph.sane(entities, relations, known)[1]


# pictures


def _pictures(spark: SparkSession, d: str) -> DataFrame:
    """Parts as pictures: of many shapes, on pages of known area or not, of three types."""
    head = F.when(F.col("p_size") % 3 == 0, F.unhex(F.lit("89504E470D0A1A0A"))).when(F.col("p_size") % 3 == 1, F.unhex(F.lit("FFD8FF"))).otherwise(F.lit("??").cast("binary"))
    area = F.when(F.col("p_partkey") % 5 > 0, F.lit(20000.0))
    return table(spark, d, "part").select(
        F.col("p_brand").alias("document_id"), F.col("p_partkey").alias("image_id"), F.concat(head, F.col("p_name").cast("binary")).alias("content"),
        (F.col("p_size") * 10).alias("width"), (F.col("p_partkey") % 97 + 1).cast("int").alias("height"), area.alias("page_area"), (F.col("p_partkey") % 7 == 0).alias("dense"), F.lit(1).alias("page"), F.lit(None).cast("string").alias("source_uri"),
    )


_PICTURES = """(SELECT p_brand AS document_id, p_partkey AS image_id, CASE p_size % 3 WHEN 0 THEN '\\x89PNG\\x0D\\x0A\\x1A\\x0A'::BLOB WHEN 1 THEN '\\xFF\\xD8\\xFF'::BLOB ELSE '??'::BLOB END || encode(p_name) AS content,
  CASE p_size % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' END AS mime, CAST(p_size * 10 AS DOUBLE) AS w, CAST(p_partkey % 97 + 1 AS DOUBLE) AS h, p_partkey % 5 > 0 AS paged, p_partkey % 7 = 0 AS dense FROM part)"""
_ROUTE = "CASE WHEN NOT paged THEN 'text' WHEN w * h / 20000 < 0.05 THEN 'skip' WHEN w / h > 8 OR w / h < 0.125 THEN 'skip' WHEN {dense} THEN 'ocr' ELSE 'vision' END"


@query(f"SELECT image_id, mime, {_ROUTE.format(dense='dense')} AS route FROM {_PICTURES}")
def vision_route(spark, d):
    p = _pictures(spark, d)
    return p.select("image_id", vision.mime(F.col("content")).alias("mime"), vision.route(F.col("width"), F.col("height"), F.col("page_area"), F.col("dense")).alias("route"))


@query(f"""
SELECT document_id || '::img::' || image_id AS request_id, document_id, 'Describe.' AS prompt, 'data:image/' || coalesce(mime, 'png') || ';base64,' || to_base64(content) AS image_url
FROM {_PICTURES} WHERE NOT paged OR {_ROUTE.format(dense="false")} = 'vision'""")
def vision_requests(spark, d):
    return vision.requests(_pictures(spark, d), "Describe.").select("request_id", "document_id", "prompt", "image_url")


@query(f"""
SELECT document_id || '::img::' || image_id AS eu_id, document_id, 'Part ' || image_id || chr(10) || 'image type: photo' || chr(10) || document_id || ', box' || chr(10) || 'n: ' || image_id AS text
FROM {_PICTURES} WHERE (NOT paged OR {_ROUTE.format(dense="false")} = 'vision') AND image_id % 3 > 0""")
def vision_units(spark, d):
    """A third of the requests has no answer."""
    p = _pictures(spark, d)
    asked = vision.requests(p, "Describe.")
    ident = F.col("image_id").cast("string")
    empty = F.array().cast("array<string>")
    record = F.struct(F.concat(F.lit("Part "), ident).alias("short_caption"), F.lit(" ").alias("detailed_description"), F.lit("photo").alias("image_type"), F.array(F.col("document_id"), F.lit("box")).alias("objects"), empty.alias("relationships"), F.lit(None).cast("string").alias("ocr_text"), F.array(F.struct(F.lit("n").alias("label"), ident.alias("value"))).alias("data_values"))
    said = p.filter("image_id % 3 > 0").select(F.concat_ws("::", "document_id", F.lit("img"), "image_id").alias("request_id"), record.alias("record"))
    return vision.units(asked, said).select("eu_id", "document_id", "text")


# queue


def _queue(spark: SparkSession, d: str) -> DataFrame:
    """Orders as jobs, first come first."""
    status = F.when(F.col("o_orderstatus") == "P", "queued").when(F.col("o_orderstatus") == "O", F.when(F.col("o_custkey") % 2 == 0, "running").otherwise("failed")).otherwise(F.when(F.col("o_custkey") % 3 == 0, "dead").otherwise("done"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_orderkey").alias("seq"), status.alias("status"), (F.col("o_custkey") % 3).alias("attempts"))


_QUEUE = """(SELECT o_orderkey AS job, CASE o_orderstatus WHEN 'P' THEN 'queued' WHEN 'O' THEN CASE WHEN o_custkey % 2 = 0 THEN 'running' ELSE 'failed' END ELSE CASE WHEN o_custkey % 3 = 0 THEN 'dead' ELSE 'done' END END AS status, o_custkey % 3 AS attempts FROM orders)"""


@query("SELECT DISTINCT l_linenumber AS attempt, CAST(least(2.0 * pow(3, l_linenumber - 1), 100) AS DOUBLE) AS delay FROM lineitem")
def retry_backoff(spark, d):
    n = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("attempt")).distinct()
    return n.select("attempt", jobs.backoff(F.col("attempt"), 2.0, 3.0, 100.0).alias("delay"))


@query("SELECT o_custkey AS job, 'old' AS state FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey UNION ALL SELECT DISTINCT o_custkey, 'new' FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def enqueue_jobs(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("job"), "o_orderstatus")
    known = o.filter("o_orderstatus = 'F'").select("job", F.lit("old").alias("state")).distinct()
    return jobs.enqueue(known, o.select("job", F.lit("new").alias("state")))


@query(f"SELECT job, 'running' AS status FROM {_QUEUE} WHERE status = 'queued' ORDER BY job LIMIT 5")
def job_lease(spark, d):
    return jobs.lease(_queue(spark, d), 5).select("job", "status")


@query(f"SELECT job, row_number() OVER (ORDER BY job) AS place FROM {_QUEUE} WHERE status = 'failed'")
def job_list(spark, d):
    listed = jobs.by_status(_queue(spark, d), "failed")
    return listed.select("job", F.row_number().over(Window.orderBy("seq")).cast("bigint").alias("place"))


@query(f"SELECT job, CASE WHEN status IN ('running', 'failed') THEN 'queued' ELSE status END AS status, attempts FROM {_QUEUE}")
def job_resume(spark, d):
    return jobs.resume(_queue(spark, d)).select("job", "status", "attempts")


@query(f"SELECT job, CASE status WHEN 'dead' THEN 'queued' ELSE status END AS status, CASE status WHEN 'dead' THEN 0 ELSE attempts END AS attempts FROM {_QUEUE}")
def job_redrive(spark, d):
    return jobs.redrive(_queue(spark, d)).select("job", "status", "attempts")


# languages


_CHAIN = "CASE doc_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'it' WHEN 2 THEN NULL ELSE 'auto' END"


@query(f"SELECT doc_id, CASE WHEN {_CHAIN} = 'it' THEN 'it' WHEN {_CHAIN} = 'auto' AND n_chars >= 500 THEN lang WHEN doc_id % 3 = 0 THEN 'nl' ELSE 'en' END AS language FROM documents")
def answer_language(spark, d):
    """Asked for outright, by detection or not at all; detections of short texts aren't reliable; a third has a conversation's language."""
    docs = table(spark, d, "documents")
    k = F.col("doc_id") % 4
    explicit = F.when(k == 1, "it").when(k.isin(0, 3), "auto")
    found = F.struct(F.col("lang").alias("language"), F.when(F.col("n_chars") >= 500, 0.5).otherwise(0.49).alias("confidence"))
    return docs.select("doc_id", language.requested(explicit, found, F.when(F.col("doc_id") % 3 == 0, "nl")).alias("language"))


@query(f"""
WITH w AS (SELECT doc_id, regexp_matches(text, '[\\p{{L}}]') AS letters, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: regexp_full_match(x, '\\p{{L}}+'))) AS w FROM documents),
h AS (SELECT doc_id, letters, {", ".join(f"{_hits(k)} AS {k}" for k in language.T.LATIN_CUES)} FROM w)
SELECT doc_id, CASE WHEN greatest(es, fr, de) = 0 THEN 'en' WHEN es >= fr AND es >= de THEN 'es' WHEN fr >= de THEN 'fr' ELSE 'de' END AS language, CASE WHEN letters THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence, letters AS reliable FROM h""")
def language_majority(spark, d):
    """By the script of most letters; here it is the Latin one throughout."""
    return table(spark, d, "documents").select("doc_id", language.detected("text").alias("d")).select("doc_id", "d.*")


@query("SELECT o_orderkey, greatest(a, b, c) >= 0.4 AND a + b + c - greatest(a, b, c) - least(a, b, c) >= 0.4 AS mixed FROM (SELECT o_orderkey, o_custkey % 10 / 10.0::DOUBLE AS a, o_orderkey % 10 / 10.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM orders)")
def code_mixing(spark, d):
    shares = F.array((F.col("o_custkey") % 10) / 10.0, (F.col("o_orderkey") % 10) / 10.0, F.lit(0.0))
    return table(spark, d, "orders").select("o_orderkey", language.code_mixed(shares).alias("mixed"))


# telemetry


@query(f"SELECT event_type AS stage, round(sum({_COST}), 4) AS cost, count(*) AS n FROM events WHERE user_id < 50 OR user_id = 77 AND event_type = 'click' GROUP BY 1")
def cost_scoped(spark, d):
    log = _log(spark, d).withColumn("tenant", F.when(F.col("partition") < 50, "a").otherwise(F.col("partition").cast("string")))
    allowed = spark.createDataFrame([("a", None), ("77", "click")], "tenant string, stage string")
    return telemetry.rollup(state.in_scope(log, allowed, ["tenant", "stage"]), "stage")


# extraction


@query("""
SELECT DISTINCT url, CASE lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'txt' THEN 'txt' WHEN 'csv' THEN 'csv' WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html' WHEN 'pdf' THEN 'pdf' WHEN 'py' THEN 'code' ELSE 'plain' END AS source_type
FROM (SELECT regexp_replace(url, '[?#].*$', '') || CASE page_id % 6 WHEN 0 THEN '.txt' WHEN 1 THEN '.CSV' WHEN 2 THEN '.htm' WHEN 3 THEN '.pdf' WHEN 4 THEN '.py' ELSE '.unknown' END AS url FROM pages)""")
def source_types(spark, d):
    k = F.col("page_id") % 6
    ending = F.when(k == 0, ".txt").when(k == 1, ".CSV").when(k == 2, ".htm").when(k == 3, ".pdf").when(k == 4, ".py").otherwise(".unknown")
    named = table(spark, d, "pages").select(F.concat(F.regexp_replace("url", "[?#].*$", ""), ending).alias("url")).distinct()
    return named.select("url", extract.source_type(F.col("url")).alias("source_type"))


def _as(spark: SparkSession, rows: DataFrame, kind: str, text: Column, key: str) -> DataFrame:
    return extract.extract(rows.select(F.col(key).alias("document_id"), text.cast("binary").alias("content"), F.lit(kind).alias("source_type")))


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"""
SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS INTEGER) AS block, text FROM (
  SELECT CAST(item_id AS VARCHAR) AS document_id, unnest(p) AS text, generate_subscripts(p, 1) AS i FROM (
    SELECT item_id, list_filter(list_transform(string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10) || chr(10)), lambda x: trim(x, {_WHITE})), lambda x: x <> '') AS p FROM benchmark))""")
def txt_blocks(spark, d):
    """Sentences set apart by blank lines."""
    return _as(spark, table(spark, d, "benchmark"), "txt", F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n")), "item_id").select("document_id", "block", "text")


@query("SELECT CAST(doc_id AS VARCHAR) AS document_id, sha256(text) AS checksum FROM documents")
def plain_blocks(spark, d):
    return _as(spark, table(spark, d, "documents"), "plain", F.col("text"), "doc_id").select("document_id", F.sha2("text", 256).alias("checksum"))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS document_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS block, 'key: ' || n_nationkey || ', name: ' || n_name AS text FROM nation")
def csv_blocks(spark, d):
    """A file a region, a row a nation."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: F.concat(s["n_nationkey"].cast("string"), F.lit(',"'), s["n_name"], F.lit('"')))
    files = table(spark, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("key,name\n"), F.array_join(lines, "\n")).alias("t"))
    return _as(spark, files, "csv", F.col("t"), "n_regionkey").select("document_id", "block", "text")


@query("""
SELECT CAST(n_regionkey AS VARCHAR) AS document_id, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey""")
def markdown_tables(spark, d):
    n = table(spark, d, "nation")
    position = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    blocks = n.select(F.col("n_regionkey").cast("string").alias("document_id"), position.alias("block"), F.lit("table").alias("kind"), F.lit("").alias("text"), F.lit(None).cast("int").alias("level"), F.array(F.lit("key"), F.lit("name")).alias("path"), F.array(F.col("n_nationkey").cast("string"), F.col("n_name")).alias("cells"))
    return extract.to_markdown(blocks)


@query("SELECT CAST(c_custkey AS VARCHAR) AS document_id, 'c_custkey: ' || c_custkey || ', c_name: ' || c_name || ', c_nationkey: ' || c_nationkey || ', c_mktsegment: ' || c_mktsegment AS text, c_custkey % 7 = 0 AS broken FROM customer WHERE c_custkey % 7 > 0 UNION ALL SELECT CAST(c_custkey AS VARCHAR), NULL, true FROM customer WHERE c_custkey % 7 = 0")
def damaged_files(spark, d):
    """A seventh of the files is no archive although it is said to be: each of these gives an error and stops no other."""
    c = table(spark, d, "customer")
    head = "c_custkey,c_name,c_nationkey,c_mktsegment"
    content = F.concat(F.lit(head + "\n"), F.concat_ws(",", *head.split(",")))
    rows = c.select(F.col("c_custkey").alias("document_id"), content.cast("binary").alias("content"), F.when(F.col("c_custkey") % 7 == 0, "docx").otherwise("csv").alias("source_type"))
    return extract.extract(rows).select("document_id", "text", F.col("error").isNotNull().alias("broken"))
