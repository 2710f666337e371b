"""The engine over one store: take documents in, find, answer, forget."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.engine import config as C
from lodestone.engine import models
from lodestone.engine.plugins import Chunker, Detector, Embedder, Evaluator, GraphModel, Hooks, Memory, Registry, Reranker, Vision
from lodestone.operators import answer, authority, graph, language, memory, retrieval, state, structure, units, vision, wiki
from lodestone.sources import extract, web
from lodestone.sources.shared import cut
from lodestone.sources.store import Store, append_audit

TABLES = {
    "manifest": "document_id string, checksum string, retired array<string>, meta string, language string",
    "units": "document_id string, eu_id string, block_ref string, block int, chunk int, kind string, text string, passage string, checksum string",
    "structure": "document_id string, position bigint, level int, label string, parent bigint",
    "blobs": "document_id string, checksum string, content binary",
    "vectors": "document_id string, eu_id string, v array<double>",
    "pages": "document_id string, title string, summary string, keywords array<string>, n_units bigint",
    "edges": "document_id string, source string, target string, weight bigint",
}
"""Edges belong to no document: their ``document_id`` is their source, and the table is replaced outright."""
HEAD = 2000


class Engine:
    def __init__(self, spark: SparkSession, root: str, config: Mapping | None = None, registry: Registry | None = None, hooks: Hooks | None = None, generate: answer.Generator = answer.extractive, decide: answer.Decider = answer.lacking, reformulate: models.Reformulator | None = None, context: Callable[[str], str] | None = None, sink: Callable[[DataFrame], None] | None = None):
        self.spark, self.root = spark, root
        self.config = dict(config) if config is not None else C.load(env={})
        self.registry, self.hooks = registry or Registry(), hooks or Hooks()
        self.generate, self.decide, self.reformulate, self.context, self.sink = generate, decide, reformulate, context, sink
        self.signals = C.signals(self.config["signals"])
        self.store = Store(spark, root, TABLES)
        self.turns = spark.createDataFrame([], "conv_id string, idx bigint, question string, answer string")

    @classmethod
    def from_config(cls, spark: SparkSession, root: str, source=None, overrides: Mapping | None = None, env: Mapping[str, str] | None = None, allowed=None, **more) -> Engine:
        """Models are optional: an endpoint under ``models.generator`` writes the answers, one under ``models.reformulation`` rewrites queries; without them the engine works alone."""
        cfg = C.check(C.load(source, overrides, env), allowed)
        made = cfg.get("models", {})
        wires = {"chat": models.ChatModel, "messages": models.MessagesModel}
        build = lambda m: wires[m.get("wire", "chat")](m["base"], m["model"], m.get("headers", {}), m.get("temperature", 0.0), m.get("max_tokens"))
        if "generator" in made and "generate" not in more:
            more["generate"] = build(made["generator"]).answer
        if "reformulation" in made and "reformulate" not in more:
            more["reformulate"] = models.Reformulator(build(made["reformulation"]).complete)
        return cls(spark, root, cfg, **more)

    # taking in

    def ingest(self, documents: DataFrame) -> DataFrame:
        """(document_id, status, n_units, error) of rows (document_id, content, source_type) and, if wanted, ``seq`` (of several rows of a document the greatest counts) and ``meta``.

        Unchanged documents are skipped. All that a document had is replaced;
        blobs of former texts that no other document has are removed with it. A
        document that can't be parsed changes nothing and says why.
        """
        rows = documents
        for name, plain in (("seq", F.lit(0)), ("meta", F.lit(""))):
            if name not in rows.columns:
                rows = rows.withColumn(name, plain)
        rows = rows.filter("document_id IS NOT NULL AND content IS NOT NULL").select(F.col("document_id").cast("string"), F.col("content").cast("binary"), "source_type", "seq", "meta")
        rows = rows.withColumn("checksum", F.sha2("content", 256))
        rows = rows.groupBy("document_id").agg(F.max_by(F.struct("content", "source_type", "meta", "checksum"), F.struct("seq", "checksum")).alias("r")).select("document_id", "r.*")
        known = self.store.read("manifest")
        fresh = cut(rows.join(known.select("document_id", "checksum"), ["document_id", "checksum"], "left_anti"))
        kinds = {k: p.parse for k, p in self.registry.extractors.items()}
        blocks = cut(extract.extract(fresh, kinds))
        failed = blocks.filter("error IS NOT NULL").select("document_id", "error")
        good = fresh.join(failed, "document_id", "left_anti")
        blocks = blocks.filter("error IS NULL")
        made = self._units(blocks, good)
        if self.registry.get(Vision) is not None:
            made = cut(made.unionByName(self._figures(good)))
        stamped = self._languages(blocks)
        history = good.join(known.select("document_id", F.col("checksum").alias("_was"), F.col("retired").alias("_old")), "document_id", "left")
        retired = F.array_except(F.array_union(F.coalesce("_old", F.array().cast("array<string>")), F.when(F.col("_was").isNull(), F.array().cast("array<string>")).otherwise(F.array("_was"))), F.array("checksum"))
        manifest = history.withColumn("retired", retired).join(stamped, "document_id", "left").select("document_id", "checksum", "retired", "meta", F.coalesce("language", F.lit(self.config["answer"]["language"])).alias("language"))
        new = {"units": made, "structure": structure.index(blocks), "blobs": good.select("document_id", "checksum", "content"), "manifest": manifest}
        if "embedding" in self.signals:
            new["vectors"] = self._vectors(made)
        if "wiki" in self.signals:
            new["pages"] = self._pages(made)
        self.store.commit(new, gone=good.select("document_id"), notes={"tokenizer": state.TOKENIZER, "graph": False}, whole=("edges",))
        n = made.groupBy("document_id").agg(F.count("*").alias("n"))
        status = F.when(F.col("error").isNotNull(), "failed").when(F.col("_new"), "ingested").otherwise("unchanged")
        out = rows.select("document_id").join(failed, "document_id", "left").join(good.select("document_id", F.lit(True).alias("_new")), "document_id", "left").join(n, "document_id", "left")
        out = cut(out.select("document_id", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n_units"), "error"))
        self.hooks.fire("ingest", out)
        return out

    def _units(self, blocks: DataFrame, good: DataFrame) -> DataFrame:
        size = self.config["chunk"]
        texts = blocks.filter("kind <> 'image'").select("document_id", "block", "kind", "text")
        chunker = self.registry.get(Chunker)
        cutup = units.chunked(texts.select("document_id", "block", "text"), size["max_words"], size["overlap"], chunker.chunk if chunker is not None else None).join(texts.select("document_id", "block", "kind"), ["document_id", "block"])
        cutup = cutup.withColumns({"block_ref": F.concat_ws("::", "document_id", F.col("block").cast("string")), "text": F.col("passage"), "checksum": state.checksum(F.col("passage"))})
        if self.context is not None:  # only rankings read ``text``; passages stay verbatim
            whole = blocks.groupBy("document_id").agg(F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda s: s["text"]), "\n"), F.lit(8000)).alias("_doc"))
            complete = self.context
            said = F.udf(lambda chunk, doc: models.contextual(chunk, doc or "", complete))
            cutup = cutup.join(whole, "document_id", "left").withColumn("text", said("passage", "_doc"))
        return cut(cutup.select("document_id", "eu_id", "block_ref", "block", "chunk", "kind", "text", "passage", "checksum"))

    def _figures(self, good: DataFrame) -> DataFrame:
        """Units made of a model's answers to picture files; one that fails gives none."""
        none = lambda kind: F.lit(None).cast(kind)
        pictures = good.filter("source_type = 'image'").select("document_id", F.lit("0").alias("image_id"), "content", none("int").alias("width"), none("int").alias("height"), none("double").alias("page_area"), none("int").alias("page"), F.col("document_id").alias("source_uri"))
        asked = cut(vision.requests(pictures, models.DESCRIBE))
        said = cut(vision.fulfil(asked, self.registry.get(Vision).describe))
        made = vision.units(asked, said.filter("error IS NULL"))
        return made.select("document_id", "eu_id", F.col("eu_id").alias("block_ref"), F.lit(0).alias("block"), F.lit(0).alias("chunk"), F.lit("figure").alias("kind"), "text", F.col("text").alias("passage"), state.checksum(F.col("text")).alias("checksum"))

    def _languages(self, blocks: DataFrame) -> DataFrame:
        """By the first ``HEAD`` characters of a document's blocks; one that isn't told reliably has none."""
        parts = F.transform(F.array_sort(F.collect_list(F.struct("block", F.left("text", F.lit(HEAD)).alias("t")))), lambda s: s["t"])
        head = blocks.filter(F.col("block") < HEAD).groupBy("document_id").agg(F.left(F.array_join(parts, "\n"), F.lit(HEAD)).alias("head"))
        told = head.select("document_id", (self._detector() or language.detected)("head").alias("d"))
        return told.select("document_id", F.when(F.col("d.reliable"), F.col("d.language")).alias("language"))

    def _detector(self):
        plugin = self.registry.get(Detector)
        if plugin is None:
            return None
        return F.udf(lambda t: plugin.detect(t or ""), "language string, confidence double, reliable boolean")

    def _embed(self, rows: DataFrame) -> DataFrame:
        plugin = self.registry.get(Embedder)
        return models.embed(rows, plugin.embed, plugin.dim) if plugin is not None else retrieval.embedded(rows)

    def _vectors(self, made: DataFrame) -> DataFrame:
        v = self._embed(made.select(F.col("eu_id").alias("id"), "text"))
        return v.join(made.select(F.col("eu_id").alias("id"), "document_id"), "id").select("document_id", F.col("id").alias("eu_id"), "v")

    def _pages(self, made: DataFrame) -> DataFrame:
        rows = made.select(F.col("document_id").alias("page_id"), F.struct("block", "chunk").alias("unit"), "text")
        return wiki.pages(rows).withColumnRenamed("page_id", "document_id")

    def crawl(self, pages: DataFrame, seeds: DataFrame, max_pages: int = web.PAGES, max_depth: int = web.DEPTH) -> DataFrame:
        """``ingest`` of the pages (url, html) that the seeds lead to."""
        found = web.crawl(pages, seeds, max_depth, max_pages).select("url")
        return self.ingest(pages.join(found, "url", "left_semi").select(F.col("url").alias("document_id"), F.col("html").cast("binary").alias("content"), F.lit("html").alias("source_type")))

    def fetch(self, urls: list[str], transport: Callable[[str], tuple[bytes, str]] | None = None) -> DataFrame:
        """``ingest`` of a few addresses, fetched by the driver; crawls go over a table of pages."""
        rows = [(u, bytearray(models.fetch(u, transport)[0]), "html") for u in urls]
        return self.ingest(self.spark.createDataFrame(rows, "document_id string, content binary, source_type string"))

    def _files(self, path: str, glob: str | None = None) -> DataFrame:
        reader = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")

    def ingest_files(self, path: str) -> DataFrame:
        return self.ingest(self._files(path).select(F.col("path").alias("document_id"), "content", extract.source_type(F.col("path")).alias("source_type")))

    def ingest_code(self, path: str) -> DataFrame:
        """Python and Go sources below a folder; needs the graph's signal."""
        if not self.signals & {"graph", "community"}:
            raise ValueError("code is of use with the signal graph only")
        return self.ingest(extract.code_files(self._files(path)).select(F.col("path").alias("document_id"), "content", F.lit("code").alias("source_type")))

    def ingest_schema(self, path: str) -> DataFrame:
        """DDL and OpenAPI files; others are taken as plain text. An address of a live database is an error."""
        if path.split("://")[0] in ("postgres", "postgresql", "mysql", "mssql", "oracle", "sqlite", "jdbc") or path.startswith("jdbc:"):
            raise ValueError("give an exported schema, not a database")
        files = self._files(path)
        kind = F.coalesce(extract.schema_type(F.col("path"), F.decode("content", "utf-8")), F.lit("plain"))
        return self.ingest(files.select(F.col("path").alias("document_id"), "content", kind.alias("source_type")))

    def refresh(self) -> None:
        """The graph and all wiki pages anew, of the units as they are."""
        u = self.store.read("units")
        rows = u.select(F.col("eu_id").alias("unit"), "text")
        plugin = self.registry.get(GraphModel)
        e = graph.edges(rows) if plugin is None else graph.distil(rows, plugin.distil)[1].select("source", "target", "weight")
        e = e.withColumn("document_id", F.col("source"))
        new = {"edges": e} | ({"pages": self._pages(u)} if "wiki" in self.signals else {})
        self.store.commit(new, notes={"graph": True}, whole=("edges", "pages"))

    def edges(self) -> DataFrame:
        """The co-mention graph; made anew first if documents came or went since."""
        if not self.store.note("graph"):
            self.refresh()
        return self.store.read("edges").drop("document_id")

    # finding

    def variants(self, questions: DataFrame, languages: list[str] | None = None) -> list[DataFrame]:
        """The questions, and their rewrites by language; an unsupported language, or several without a model to rewrite, is an error."""
        asked = language.search_languages(languages or ["en"])
        if self.reformulate is None:
            if len(asked) > 1:
                raise language.CannotSearch("several languages need a model that rewrites queries")
            return [questions]
        rows = [(r["question_id"], q) for r in questions.select("question_id", "question").collect() for q in self.reformulate.queries(r["question"], asked)]  # a model call each: few by nature
        more = self.spark.createDataFrame(rows, f"question_id {questions.schema['question_id'].dataType.simpleString()}, question string")
        return [questions.select("question_id", "question"), more]

    def retrieve(self, questions: DataFrame, k: int | None = None, languages: list[str] | None = None, conversations: DataFrame | None = None) -> DataFrame:
        """(question_id, doc_id, score, best_list, rank): the k best units after fusion of every signal's list for every variant of the questions. ``doc_id`` is a unit's id."""
        k = k or self.config["retrieval"]["k"]
        if conversations is not None:  # (question_id, conv_id)
            q = questions.join(conversations, "question_id")
            wide = memory.expanded(q.select(F.col("question_id").cast("string").alias("conv_id"), F.col("question").alias("query")), self.turns.join(q.select("conv_id", F.col("question_id").cast("string").alias("_q")), "conv_id").drop("conv_id").withColumnRenamed("_q", "conv_id"))
            questions = questions.join(wide.select(F.col("conv_id").alias("_q"), "query"), F.col("question_id").cast("string") == F.col("_q"), "left").select("question_id", F.coalesce("query", "question").alias("question"))
        variants = self.variants(questions, languages)
        u = self.store.read("units")
        docs = u.select(F.col("eu_id").alias("doc_id"), "text")
        lists: list[DataFrame] = []
        columns = ["question_id", "doc_id", "score", "rank"]
        if "text" in self.signals:
            every = retrieval.bm25_lists(variants, docs, k)
            lists += [every.filter(F.col("list") == i).select(columns) for i in range(len(variants))]
        for q in variants:
            if "embedding" in self.signals:
                lists.append(self._near(q, k).select(columns))
            if "structure" in self.signals:
                lists.append(self._by_heading(q, u, k).select(columns))
            if self.signals & {"graph", "community"}:
                lists.append(graph.retrieve(q, docs, k).select(columns))
            if "wiki" in self.signals:
                page = self.store.read("pages").withColumnRenamed("document_id", "page_id")
                links = self.spark.createDataFrame([], "page_id string, target string")
                lists.append(wiki.retrieve(q, page, links, u.select(F.col("document_id").alias("page_id"), F.col("eu_id").alias("unit")), k).select(columns))
            lists += [d.select(columns) for d in self.registry.lists(q, k)]
        fused = retrieval.top(retrieval.fuse(lists), max(k, self.config["retrieval"]["rerank_head"]))
        if self.registry.get(Reranker) is not None:
            fused = self._reranked(cut(fused), questions, docs)
        found = cut(fused.filter(F.col("rank") <= k))
        self.hooks.fire("retrieve", found)
        return found

    def _near(self, q: DataFrame, k: int) -> DataFrame:
        """Vectors are searched by numbers in the place of ids, as they are keys of integers there."""
        v = self.store.read("vectors").select("eu_id", F.xxhash64("eu_id").alias("vec_id"), F.col("v").alias("embedding"))
        asked = self._embed(q.select(F.col("question_id").alias("id"), F.col("question").alias("text")))
        plugin = self.registry.get(Embedder)
        dim = plugin.dim if plugin is not None else retrieval.DIM
        ids = asked.select(F.col("id").alias("_qid"), F.xxhash64("id").alias("question_id"), F.col("v").alias("q"))
        near = retrieval.vector_top(ids.select("question_id", "q"), v.select("vec_id", "embedding"), k, "cosine", dim)
        return near.join(ids.select("_qid", "question_id"), "question_id").join(v.select("vec_id", F.col("eu_id").alias("doc_id")), "vec_id").select(F.col("_qid").alias("question_id"), "doc_id", "score", "rank")

    def _by_heading(self, q: DataFrame, u: DataFrame, k: int) -> DataFrame:
        tree = structure.parents(self.store.read("structure").select("document_id", "position", "level", "label"))
        nodes = structure.retrieve(q, tree, k)
        held = structure.resolve(nodes.select(F.col("node").alias("ref")).distinct(), u.select("eu_id", "block_ref"))
        hits = nodes.join(held.withColumnRenamed("ref", "node"), "node").groupBy("question_id", F.col("eu_id").alias("doc_id")).agg(F.max("score").alias("score"))
        return retrieval.top(hits, k)

    def _reranked(self, fused: DataFrame, questions: DataFrame, docs: DataFrame) -> DataFrame:
        import pandas as pd

        order = self.registry.get(Reranker).order
        head = fused.join(docs, "doc_id").join(questions.select("question_id", "question"), "question_id")

        def f(b: pd.DataFrame) -> pd.DataFrame:
            b = b.sort_values("rank")
            at = order(b["question"].iloc[0], list(b["text"].fillna("")))
            out = b.iloc[at][["question_id", "doc_id", "score", "best_list"]].copy()
            out["rank"] = range(1, len(out) + 1)
            return out

        return head.groupBy("question_id").applyInPandas(f, fused.schema)  # the head of a list: a few rows a question

    # answering

    def ask(self, questions: DataFrame, mode: str = "strict", strategy: str = "strict", k: int | None = None, languages: list[str] | None = None, conversations: DataFrame | None = None) -> DataFrame:
        docs = self.store.read("units").select(F.col("eu_id").alias("doc_id"), F.col("passage").alias("text"))
        tiers, floor = self._standing()
        if strategy == "deep":
            if languages is not None and len(languages) > 1:
                raise ValueError("a deep search asks its own queries; name one language")
            b = self.config["deep"]
            return answer.ask_deep(questions, docs, tiers, floor, mode, self.generate, self.decide, k=b["search_k"], hops=b["max_hops"], calls=b["max_tool_calls"], most_units=b["max_evidence_units"], seconds=b["timeout_s"])
        if strategy != "strict":
            raise ValueError(f"unknown strategy {strategy}")
        found = self.retrieve(questions, k, languages, conversations)
        result = cut(answer.ask(questions, found, docs, tiers, floor, mode, self.generate))
        if conversations is not None:
            said = result.filter("decision = 'answered'").join(conversations, "question_id").join(questions.select("question_id", "question"), "question_id")
            self.remember(said.select("conv_id", "question", "answer"))
        if self.sink is not None:
            self.sink(result.select(F.lit("generate").alias("stage"), F.col("doc_id").alias("document"), F.when(F.col("decision") == "answered", "ok").otherwise("refused").alias("outcome"), F.current_timestamp().alias("ts")))
        self.hooks.fire("answer", result)
        return result

    def _standing(self) -> tuple[DataFrame | None, int | None]:
        rules = self.config["authority"]
        if not rules["key"]:
            return None, None
        floor = authority.floor_rank(rules["floor"], rules["order"]) if rules["floor"] else None
        tier = self.store.read("manifest").select("document_id", authority.tier_of(F.col("meta"), rules["key"], rules["order"])["rank"].alias("tier_rank"))
        return self.store.read("units").select("document_id", F.col("eu_id").alias("doc_id")).join(tier, "document_id").select("doc_id", "tier_rank"), floor

    def stream(self, results: DataFrame) -> DataFrame:
        return answer.stream(results.filter("decision = 'answered'"), "question_id", "answer")

    def remember(self, said: DataFrame) -> None:
        """Turns (conv_id, question, answer) behind those that a conversation has; the newest ``memory.RING`` stay."""
        last = self.turns.groupBy("conv_id").agg(F.max("idx").alias("_last"))
        numbered = said.join(last, "conv_id", "left").withColumn("idx", F.coalesce("_last", F.lit(-1)) + F.row_number().over(memory.Window.partitionBy("conv_id").orderBy("question")))
        self.turns = cut(memory.ring(self.turns.unionByName(numbered.select("conv_id", F.col("idx").cast("bigint"), "question", "answer"))))

    def recall(self, queries: DataFrame, limit: int = memory.RECALL) -> DataFrame:
        plugin = self.registry.get(Memory)
        return plugin.recall(queries) if plugin is not None else memory.recall(queries, self.turns, limit).join(self.turns, ["conv_id", "idx"])

    def evaluate(self, golden: str | DataFrame) -> DataFrame:
        """Of a CSV file with a column ``question`` or ``query`` and, if wanted, ``expected``, or of (question_id, question, expected)."""
        if isinstance(golden, str):
            rows = self.spark.read.csv(golden, header=True, multiLine=True, escape='"')
            name = next((c for c in ("question", "query") if c in rows.columns), None)
            if name is None:
                raise ValueError("the file has no column question or query")
            expected = F.col("expected") if "expected" in rows.columns else F.lit("")
            golden = cut(rows.select(F.monotonically_increasing_id().alias("question_id"), F.col(name).alias("question"), F.coalesce(expected, F.lit("")).alias("expected")))
        results = self.ask(golden.select("question_id", "question"))
        plugin = self.registry.get(Evaluator)
        return plugin.evaluate(results, golden) if plugin is not None else answer.evaluate(results, golden)

    # forgetting

    def index(self) -> DataFrame:
        """(doc_id, checksum) of all that is held."""
        m = self.store.read("manifest").select(F.col("document_id").alias("doc_id"), "checksum")
        return state.indexed(m, self.store.read("units").select(F.col("document_id").alias("doc_id"), F.lit("").alias("checksum")))

    def reconcile(self, declared: DataFrame, audit: bool = True) -> DataFrame:
        """The index against (doc_id, checksum, current)."""
        report = cut(state.reconcile(self.index(), declared))
        if audit:
            append_audit(report.withColumn("event", F.lit("reconcile")), self.root)
        return report

    def revoke(self, documents: DataFrame) -> DataFrame:
        """(document_id, status): all that the documents left in any layer is removed; one that isn't there is ``absent``.

        A blob is kept in its document's own row, so another document with the
        same content keeps its own.
        """
        gone = documents.select(F.col("document_id").cast("string")).distinct()
        held = cut(gone.join(self.store.read("manifest").select("document_id", F.lit(True).alias("_here")), "document_id", "left").join(self.store.read("units").select("document_id").distinct().withColumn("_loose", F.lit(True)), "document_id", "left"))
        self.store.commit({}, gone=gone, notes={"graph": False}, whole=("edges",))
        out = held.select("document_id", F.when(F.col("_here") | F.col("_loose"), "deleted").otherwise("absent").alias("status"))
        self.hooks.fire("delete", out)
        return out

    def remediate(self, report: DataFrame, audit: bool = True) -> DataFrame:
        """Revokes a report's orphans, nothing else."""
        done = cut(self.revoke(state.orphans(report).select(F.col("doc_id").alias("document_id"))))
        if audit:
            append_audit(done.withColumn("event", F.lit("remediate")), self.root)
        return done

    def is_stale(self) -> bool:
        """Whether the index was made by another tokenizer."""
        return self.store.version() > 0 and (self.store.note("tokenizer") or 1) != state.TOKENIZER

    # tools

    def tools(self) -> list[dict]:
        """Descriptions and handlers of what an agent may call; ``passage`` is all that may be quoted."""
        one = lambda q: self.spark.createDataFrame([(0, q)], "question_id int, question string")
        rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
        spec = lambda name, about, handler, **args: {"name": name, "description": about, "parameters": {"type": "object", "properties": args, "required": [k for k, v in args.items() if "default" not in v]}, "handler": handler}
        text = {"type": "string"}

        def search(query: str, k: int = 5) -> list[dict]:
            u = self.store.read("units").withColumnRenamed("eu_id", "doc_id")
            return rows(self.retrieve(one(query), k).join(u, "doc_id").select(F.col("doc_id").alias("eu_id"), "document_id", "text", "passage", "score", "rank").orderBy("rank"))

        def page(page_id: str) -> dict | None:
            found = rows(self.store.read("pages").filter(F.col("document_id") == page_id))
            return found[0] if found else None

        def evidence(eu_id: str) -> dict | None:
            found = rows(self.store.read("units").filter(F.col("eu_id") == eu_id))
            return found[0] if found else None

        def neighbors(entity: str) -> list[dict]:
            needle = self.spark.createDataFrame([(entity.strip().lower(),)], "needle string")
            return rows(graph.neighbors(needle, self.edges()).orderBy("neighbor"))

        return [
            spec("search_evidence", "Ranked evidence for a query.", search, query=text, k={"type": "integer", "default": 5}),
            spec("wiki_index", "All pages' titles, summaries and keywords, to find one's way by; not to be quoted.", lambda: rows(self.store.read("pages").select("document_id", "title", "summary", "keywords").orderBy("document_id"))),
            spec("wiki_page", "One page by its id; not to be quoted.", page, page_id=text),
            spec("graph_neighbors", "Terms that stand beside the first one that contains the given text.", neighbors, entity=text),
            spec("get_evidence", "One unit by its id.", evidence, eu_id=text),
        ]
