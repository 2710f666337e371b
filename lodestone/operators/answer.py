"""Answers that cite, or refuse: the strict flow and the search in several hops.

Both flows work on all questions at once. Texts are joined once, by the few
candidates of each question, and cut; the last step settles a question from its
own few passages.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import gate as G
from lodestone.functions import text as X
from lodestone.operators import authority, conflict
from lodestone.operators.retrieval import bm25, bm25_lists, fuse, top
from lodestone.sources.shared import cut, few

ATTEMPTS = 5
REASONS = ("unsupported script", "nothing relevant", "insufficient authority", "not grounded", "unresolved conflict", "nothing readable")
HOPS, CALLS, UNITS, SEARCH_K, SECONDS = 4, 10, 40, 5, 60.0
Generator = Callable[[str, str], str]
Decider = Callable[[str, Sequence[str]], "tuple[bool, str | None]"]


def extractive(question: str, passage: str) -> str:
    """The generator without a model: the passage itself."""
    return passage


def relevant(candidates: DataFrame, questions: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates with text and ``relevant``: whether question and text share a content token."""
    q = questions.select("question_id", X.tokens_any(F.col("question")).alias("_q"))
    rows = few(candidates).join(docs.select("doc_id", "text"), "doc_id").join(q, "question_id")
    return rows.withColumn("relevant", G.relevant(F.col("_q"), X.tokens_any(F.col("text")))).drop("_q")


def note(blocked: Sequence[tuple[object, Sequence[str]]]) -> str | None:
    """What to say of documents that couldn't be read: how many, which, and their scripts."""
    if not blocked:
        return None
    return f"unreadable: {len(blocked)} documents: " + ", ".join(f"{d} ({', '.join(sorted(s))})" for d, s in blocked)


def settle(question: str, gap: Sequence[str], passages: Sequence[dict], pairs: Sequence[tuple[int, int, str | None, bool]], blocked: Sequence[tuple[object, Sequence[str]]], n_readable: int, n_relevant: int, mode: str, generate: Generator) -> dict:
    """The answer to one question from its passages in order of standing: (doc_id, text, score, tier_rank) each.

    ``pairs``: (left, right, rule, clone) of positions from 0. The first passage
    out of ``ATTEMPTS`` whose draft has a claim that it supports is cited, with
    its supported claims; in strict mode a contradiction among the first
    ``conflict.WINDOW`` that it takes part in makes it a refusal that cites both sides.
    """
    out: dict = dict.fromkeys(("reason", "doc_id", "answer", "tier"))
    out |= {"decision": "refused", "n_claims": None, "n_supported": None, "cited": [], "conflicts": 0, "supporting": 0, "spread": None, "notes": []}
    readable = note(blocked)
    if gap:
        return out | {"reason": REASONS[0], "notes": [", ".join(sorted(gap))]}
    if not n_relevant:
        if blocked and not n_readable:
            return out | {"reason": REASONS[5], "notes": [readable]}
        return out | {"reason": REASONS[1], "notes": [readable] if readable else []}
    if not passages:
        return out | {"reason": REASONS[2]}
    said = [readable] if readable else []
    against = [(a, b) for a, b, rule, _ in pairs if rule is not None and b < conflict.WINDOW]
    independent = conflict.survivors(len(passages), {(a, b) for a, b, _, clone in pairs if clone})
    scores = [p["score"] for p in passages]
    out |= {"conflicts": len(against), "supporting": len(independent), "spread": round(max(scores) - min(scores), 6)}
    for place, p in enumerate(passages[:ATTEMPTS]):
        held = X.tokenize(p["text"] or "")
        claims = X.split_claims(generate(question, p["text"] or ""))
        kept = [c for c in claims if G.supported_by(c, held)]
        if kept:
            break
    else:
        return out | {"reason": REASONS[3], "notes": said}
    touching = [x for x in against if place in x]
    if touching and mode == "strict":
        sides = list(dict.fromkeys(passages[i]["doc_id"] for x in sorted(touching) for i in x))
        return out | {"reason": REASONS[4], "cited": sides}
    return out | {"decision": "answered", "doc_id": p["doc_id"], "answer": " ".join(kept), "n_claims": len(claims), "n_supported": len(kept), "cited": [p["doc_id"]], "tier": p["tier_rank"], "notes": said}


def ask(questions: DataFrame, candidates: DataFrame, docs: DataFrame, tiers: DataFrame | None = None, floor: int | None = None, mode: str = "strict", generate: Generator = extractive, evidence: DataFrame | None = None) -> DataFrame:
    """(question_id, decision, reason, doc_id, answer, n_claims, n_supported, cited, conflicts, supporting, spread, tier, notes): one row a question.

    Candidates whose text is in a script that isn't supported are taken out and
    named in ``notes``; those of the rest that share no content token with the
    question go; then come standing, contradictions and clones, and ``settle``.
    ``evidence``: (question_id, question) that relevance and scripts are judged
    by, where it isn't the question. ``supporting`` counts passages after clones are collapsed.
    """
    asked = questions.select("question_id", "question")
    judged = (evidence if evidence is not None else asked).select("question_id", F.col("question").alias("_e"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    near = relevant(candidates, judged.withColumnRenamed("_e", "question"), docs)
    near = cut(near.withColumn("scripts", X.unsupported_scripts(F.col("text"))))
    readable = near.filter(F.size("scripts") == 0)
    grounded = readable.filter("relevant")
    placed = authority.select(grounded, tiers, mode, floor) if tiers is not None else grounded.withColumns({"tier_rank": F.lit(-1), "place": F.row_number().over(Window.partitionBy("question_id").orderBy("rank")).cast("bigint")})
    placed = cut(placed.select("question_id", "place", "doc_id", "text", "score", "tier_rank"))
    pairs = conflict.compare(placed.select(F.col("question_id").alias("group"), (F.col("place") - 1).cast("int").alias("position"), "text"))
    pairs = pairs.groupBy(F.col("group").alias("question_id")).agg(F.collect_list(F.struct("left", "right", "rule", "clone")).alias("pairs"))
    passages = placed.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("place", "doc_id", "text", "score", "tier_rank"))).alias("passages"))
    counts = near.groupBy("question_id").agg(
        F.count_if(F.size("scripts") == 0).alias("n_readable"),
        F.count_if((F.size("scripts") == 0) & F.col("relevant")).alias("n_relevant"),
        F.array_sort(F.collect_list(F.when(F.size("scripts") > 0, F.struct("rank", "doc_id", "scripts")))).alias("blocked"),
    )
    rows = asked.join(judged.select("question_id", X.unsupported_scripts(F.col("_e")).alias("gap")), "question_id")
    for more in (counts, passages, pairs):
        rows = rows.join(more, "question_id", "left")

    names = ["question_id", "decision", "reason", "doc_id", "answer", "n_claims", "n_supported", "cited", "conflicts", "supporting", "spread", "tier", "notes"]

    def f(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            out = []
            for qid, question, gap, n_readable, n_relevant, blocked, held, met in b[["question_id", "question", "gap", "n_readable", "n_relevant", "blocked", "passages", "pairs"]].itertuples(index=False):
                some = lambda x: [] if x is None else list(x)
                row = settle(
                    question or "",
                    some(gap),
                    some(held),
                    [(p["left"], p["right"], p["rule"], p["clone"]) for p in some(met)],
                    [(x["doc_id"], list(x["scripts"])) for x in some(blocked)],
                    0 if pd.isna(n_readable) else int(n_readable),
                    0 if pd.isna(n_relevant) else int(n_relevant),
                    mode,
                    generate,
                )
                out.append((qid, *[row[k] for k in names[1:]]))
            made = pd.DataFrame(out, columns=names)
            yield made.astype({k: "Int64" for k in ("n_claims", "n_supported", "conflicts", "supporting", "tier")} | ({"doc_id": "Int64"} if kind in ("bigint", "int") else {}))

    qkind = questions.schema["question_id"].dataType.simpleString()
    schema = f"question_id {qkind}, decision string, reason string, doc_id {kind}, answer string, n_claims bigint, n_supported bigint, cited array<{kind}>, conflicts bigint, supporting bigint, spread double, tier bigint, notes array<string>"
    return rows.mapInPandas(f, schema)


def ask_strict(questions: DataFrame, candidates: DataFrame, docs: DataFrame, tiers: DataFrame | None = None, floor: int | None = None, generate: Generator = extractive) -> DataFrame:
    """``ask`` in strict mode."""
    return ask(questions, candidates, docs, tiers, floor, "strict", generate)


def hybrid(queries: list[DataFrame], docs: DataFrame, k: int) -> DataFrame:
    """The k best documents after fusion of one BM25 list a query variant."""
    return top(fuse(bm25_lists(queries, docs, k)), k)


def parse_decision(raw: str) -> tuple[bool, str | None]:
    """(sufficient, next query) from a model's reply: its first JSON object; what can't be read is not sufficient and asks nothing more."""
    m = re.search(r"\{.*\}", raw, re.S)
    try:
        said = json.loads(m[0]) if m else {}
    except ValueError:
        said = {}
    if not isinstance(said, dict):
        said = {}
    more = said.get("next_query")
    return bool(said.get("sufficient")), more if isinstance(more, str) and more.strip() else None


def bounded(f: Callable[[], object], seconds: float) -> object:
    """The result of a call, or TimeoutError if it takes longer; the call is then left to itself."""
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(f).result(timeout=max(0.0, seconds))
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def lacking(question: str, evidence: Sequence[str]) -> tuple[bool, str | None]:
    """The decider without a model: sufficient if every content token of the question is in the evidence; else those that are not are asked for."""
    stop = X.T.STOPWORDS
    held = {t for e in evidence for t in X.tokenize(e)}
    missing = [t for t in dict.fromkeys(X.tokenize(question)) if t not in stop and t not in held]
    return not missing, " ".join(missing) or None


def _decide(decide: Decider, seconds: float):
    def f(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            out = []
            for qid, question, evidence in b[["question_id", "question", "evidence"]].itertuples(index=False):
                try:
                    enough, more = bounded(lambda q=question, e=evidence: decide(q, list(e)), seconds)
                    out.append((qid, "sufficient" if enough else None if more else "no new evidence", more))
                except TimeoutError:
                    out.append((qid, "timeout", None))
            yield pd.DataFrame(out, columns=["question_id", "stop", "question"])

    return f


def gather(questions: DataFrame, docs: DataFrame, tiers: DataFrame | None = None, floor: int | None = None, mode: str = "strict", decide: Decider = lacking, k: int = SEARCH_K, hops: int = HOPS, calls: int = CALLS, most_units: int = UNITS, seconds: float = SECONDS) -> tuple[DataFrame, DataFrame]:
    """Evidence in several hops: a pool of (question_id, doc_id, hop, rank, tier_rank, score) and (question_id, stop, hops, withheld) of each question.

    Each hop searches for all open questions at once. Standing is checked before
    a document enters the pool, which holds ``most_units`` documents a question.
    A question stops when its pool is full (``budget``), when a hop brings
    nothing new and withholds nothing (``no new evidence``), or as ``decide`` says.
    """
    spark = questions.sparkSession
    qkind, dkind = (df.schema[c].dataType.simpleString() for df, c in ((questions, "question_id"), (docs, "doc_id")))
    pool = spark.createDataFrame([], f"question_id {qkind}, doc_id {dkind}, hop int, rank bigint, tier_rank int, score double")
    ended = spark.createDataFrame([], f"question_id {qkind}, stop string, hops int, withheld bigint")
    withheld = spark.createDataFrame([], f"question_id {qkind}, n bigint")
    open_ = cut(questions.select("question_id", "question"))
    for hop in range(1, min(hops, calls) + 1):
        if open_.isEmpty():
            break
        found = bm25(open_, docs, k)
        found = authority.ranked(found, tiers) if tiers is not None else found.withColumn("tier_rank", F.lit(-1))
        found = cut(found.select("question_id", "doc_id", "rank", F.col("tier_rank").cast("int"), "score"))
        held = F.col("tier_rank") >= floor if floor is not None and mode == "strict" else F.lit(True)
        withheld = withheld.unionByName(found.filter(~held).groupBy("question_id").agg(F.count("*").alias("n")))
        fresh = found.filter(held).join(pool.select("question_id", "doc_id"), ["question_id", "doc_id"], "left_anti").withColumn("hop", F.lit(hop))
        sizes = pool.groupBy("question_id").agg(F.count("*").alias("_size"))
        order = Window.partitionBy("question_id").orderBy(F.desc("tier_rank") if mode != "exploratory" else F.lit(0), "rank")
        fresh = fresh.join(sizes, "question_id", "left").withColumn("_n", F.row_number().over(order) + F.coalesce("_size", F.lit(0))).filter(F.col("_n") <= most_units)
        pool = cut(pool.unionByName(fresh.select(pool.columns)))
        now = pool.groupBy("question_id").agg(F.count("*").alias("size"), F.count_if(F.col("hop") == hop).alias("added"))
        kept_back = found.filter(~held).select("question_id").distinct().withColumn("_back", F.lit(True))
        state = open_.join(now, "question_id", "left").join(kept_back, "question_id", "left")
        stop = F.when(F.coalesce("size", F.lit(0)) >= most_units, "budget").when((F.coalesce("added", F.lit(0)) == 0) & F.col("_back").isNull(), "no new evidence")
        state = cut(state.select("question_id", "question", stop.alias("stop")))
        going = state.filter("stop IS NULL").select("question_id")
        texts = few(pool.join(going, "question_id")).join(docs.select("doc_id", "text"), "doc_id")
        texts = texts.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("hop", "rank", F.coalesce("text", F.lit("")).alias("text")))), lambda s: s["text"]).alias("evidence"))
        told = going.join(questions.select("question_id", "question"), "question_id").join(texts, "question_id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
        said = cut(told.mapInPandas(_decide(decide, seconds), f"question_id {qkind}, stop string, question string"))
        over = state.filter("stop IS NOT NULL").select("question_id", "stop").unionByName(said.filter("stop IS NOT NULL").select("question_id", "stop"))
        ended = ended.unionByName(over.select("question_id", "stop", F.lit(hop).alias("hops"), F.lit(0).cast("bigint").alias("withheld")))
        open_ = said.filter("stop IS NULL").select("question_id", "question")
    ended = ended.unionByName(open_.select("question_id", F.lit("budget").alias("stop"), F.lit(min(hops, calls)).alias("hops"), F.lit(0).cast("bigint").alias("withheld")))
    back = withheld.groupBy("question_id").agg(F.sum("n").alias("n"))
    ended = ended.join(back, "question_id", "left").select("question_id", "stop", "hops", F.coalesce("n", "withheld").alias("withheld"))
    return pool, cut(ended)


def finish(question: str, units: Sequence[dict], pairs: Sequence[tuple[int, int, str | None, bool]], withheld: int, draft: str, mode: str) -> dict:
    """The answer from a pool in order of standing: each claim of the draft is given to the first unit that supports it alone, others are dropped."""
    out: dict = {"decision": "refused", "reason": None, "answer": None, "n_claims": 0, "n_kept": 0, "cited": [], "tier": None, "n_units": len(units)}
    if not units:
        return out | {"reason": REASONS[2] if withheld else REASONS[1]}
    held = [X.tokenize(u["text"] or "") for u in units]
    claims = X.split_claims(draft)
    kept = [(c, at) for c in claims if (at := next((i for i, h in enumerate(held) if G.supported_by(c, h)), None)) is not None]
    out |= {"n_claims": len(claims), "n_kept": len(kept)}
    if not kept:
        return out | {"reason": REASONS[3]}
    used = list(dict.fromkeys(i for _, i in kept))
    touching = [(a, b) for a, b, rule, _ in pairs if rule is not None and b < conflict.WINDOW and (a in used or b in used)]
    if touching and mode == "strict":
        return out | {"reason": REASONS[4], "cited": list(dict.fromkeys(units[i]["doc_id"] for x in sorted(touching) for i in x))}
    decision = "answered" if len(kept) == len(claims) else "partial"
    return out | {"decision": decision, "answer": " ".join(c for c, _ in kept), "cited": [units[i]["doc_id"] for i in used], "tier": min(units[i]["tier_rank"] for i in used)}


def ask_deep(questions: DataFrame, docs: DataFrame, tiers: DataFrame | None = None, floor: int | None = None, mode: str = "strict", generate: Generator = extractive, decide: Decider = lacking, drafts: DataFrame | None = None, **budget) -> DataFrame:
    """(question_id, decision, reason, answer, n_claims, n_kept, cited, tier, n_units, stop, hops): evidence from ``gather``, then one draft over the whole pool.

    ``drafts``: (question_id, draft) in the place of the generator's. ``tier`` is
    the weakest among the cited.
    """
    pool, ended = gather(questions, docs, tiers, floor, mode, decide, **budget)
    by = [F.col("hop"), F.col("rank")] if mode == "exploratory" else [F.desc("tier_rank"), F.col("hop"), F.col("rank")]
    units = few(pool).join(docs.select("doc_id", "text"), "doc_id").withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy(*by)))
    units = cut(units.select("question_id", "place", "doc_id", "text", "tier_rank"))
    window = units.filter(F.col("place") <= conflict.WINDOW)
    pairs = conflict.compare(window.select(F.col("question_id").alias("group"), (F.col("place") - 1).alias("position"), "text"))
    pairs = pairs.groupBy(F.col("group").alias("question_id")).agg(F.collect_list(F.struct("left", "right", "rule", "clone")).alias("pairs"))
    held = units.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("place", "doc_id", "text", "tier_rank"))).alias("units"))
    rows = questions.select("question_id", "question")
    rows = rows.join(drafts.select("question_id", "draft"), "question_id", "left") if drafts is not None else rows.withColumn("draft", F.lit(None).cast("string"))
    for more in (held, pairs, ended):
        rows = rows.join(more, "question_id", "left")
    names = ["question_id", "decision", "reason", "answer", "n_claims", "n_kept", "cited", "tier", "n_units", "stop", "hops"]

    def f(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            out = []
            for qid, question, draft, own, met, stop, n, back in b[["question_id", "question", "draft", "units", "pairs", "stop", "hops", "withheld"]].itertuples(index=False):
                have = [] if own is None else list(own)
                said = draft if draft is not None else generate(question, "\n".join(u["text"] or "" for u in have))
                row = finish(question, have, [] if met is None else [(p["left"], p["right"], p["rule"], p["clone"]) for p in met], 0 if pd.isna(back) else int(back), said, mode)
                out.append((qid, *[row[k] for k in names[1:9]], stop, n))
            yield pd.DataFrame(out, columns=names).astype({k: "Int64" for k in ("n_claims", "n_kept", "tier", "n_units", "hops")})

    qkind = questions.schema["question_id"].dataType.simpleString()
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(f, f"question_id {qkind}, decision string, reason string, answer string, n_claims bigint, n_kept bigint, cited array<{kind}>, tier bigint, n_units bigint, stop string, hops bigint")


def evaluate(results: DataFrame, golden: DataFrame) -> DataFrame:
    """One row of counts and rates over results and (question_id, expected): a blank expectation asks for any answer, another for its content tokens in the answer."""
    rows = golden.join(results, "question_id", "left")
    said = F.coalesce("answer", F.lit(""))
    answered = F.coalesce(F.col("decision") == "answered", F.lit(False))
    wanted = X.content(X.tokens(F.coalesce("expected", F.lit(""))))
    expected = F.when(F.coalesce("expected", F.lit("")) == "", answered).otherwise((F.size(wanted) > 0) & (F.size(F.array_except(wanted, X.tokens(said))) == 0))
    out = rows.agg(
        F.count("*").alias("total"),
        F.count_if(answered).alias("answered"),
        F.count_if(answered & (F.col("n_supported") == F.col("n_claims"))).alias("grounded"),
        F.count_if(answered & F.col("doc_id").isNotNull()).alias("cited"),
        F.count_if(expected).alias("expected"),
    )
    share = lambda c, of: F.round(F.coalesce(F.col(c) / F.nullif(F.col(of), F.lit(0)), F.lit(0.0)), 6)
    return out.select("total", "answered", (F.col("total") - F.col("answered")).alias("refused"), "grounded", "cited", "expected", share("grounded", "answered").alias("grounded_rate"), share("cited", "answered").alias("cited_rate"), share("expected", "total").alias("expected_rate"))


def stream(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chunk_no, chunk): an answer's sentences, in order."""
    parts = F.filter(F.transform(F.regexp_extract_all(F.col(text), F.lit("[^.!?]+[.!?]?"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")
    return answers.select(key, F.posexplode(parts).alias("chunk_no", "chunk"))
