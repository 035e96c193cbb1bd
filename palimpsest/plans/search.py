"""The hybrid search plan: strategies, fusion, merging, expansion, reranking, budget and results in lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import access, fusion, graph, models, search
from ..schema import Config

STRATEGIES = ("dense", "lexical", "graph")


@dataclass(frozen=True)
class Store:
    """The tables of a memory store; those of the graph may be missing."""

    messages: DataFrame
    conversations: DataFrame
    participants: DataFrame
    units: DataFrame
    acl: DataFrame
    entities: DataFrame | None = None
    relations: DataFrame | None = None
    relation_sources: DataFrame | None = None
    relation_vectors: DataFrame | None = None


def graph_rows(store: Store, queries: DataFrame, config: Config, similar: DataFrame | None = None, **restrictions) -> DataFrame:
    """Ordered, named rows (fact by readable source) of the graph strategy."""
    seen = access.readable(store.conversations, store.participants, queries)
    start = graph.seeds(store.entities, queries, config.max_seeds, similar)
    found = graph.facts(graph.reachable(start, store.relations, config.max_hops), store.relations)
    rows = graph.readable_sources(found, store.relation_sources, store.messages, store.conversations, store.units, seen, store.acl, queries, **restrictions)
    rows = graph.mask(rows, store.relations)
    if store.relation_vectors is not None:
        rows = graph.distance(rows, store.relation_vectors, queries)
    return graph.named(graph.ordered(rows, config.sources_per_relation, config.graph_top_k or 20), store.entities)


def dense_list(dense: DataFrame, config: Config) -> DataFrame:
    """Dense candidates without those of queries that nothing answers, if that is asked for, and without those below the floor."""
    a, b = config.no_answer_best_below, config.no_answer_spread_below
    rows = dense if a is None or b is None else search.no_answer(dense, a, b)
    return rows.where(F.col("raw_score") >= config.minimum_dense_score)


def strategy(store: Store, queries: DataFrame, config: Config, name: str, **restrictions) -> DataFrame:
    """The ranked list of one strategy."""
    if name == "graph":
        return graph.candidates(graph_rows(store, queries, config, **restrictions))
    seen = access.readable(store.conversations, store.participants, queries)
    args = (store.units, store.messages, store.conversations, seen, store.acl, queries)
    if name == "dense":
        return dense_list(search.dense_search(*args, k=config.dense_top_k or 20, **restrictions), config)
    return search.lexical_search(*args, k=config.lexical_top_k or 20, **restrictions)


def candidates(store: Store, queries: DataFrame, config: Config, strategies: tuple[str, ...] = ("dense", "lexical"), errors: dict[str, str] | None = None, **restrictions) -> list[tuple[str, DataFrame]]:
    """The ranked list of each strategy; an unknown strategy is an error.

    With `errors`, each list is computed at once and kept in the checkpoint folder; a strategy that fails is noted there and
    left out, and only if all fail the search does.
    """
    unknown = set(strategies) - set(STRATEGIES)
    if unknown:
        raise ValueError(f"unknown strategies: {', '.join(sorted(unknown))}")
    queries = access.require_requester(queries)
    out = []
    wanted = [s for s in STRATEGIES if s in strategies and (s != "graph" or store.relations is not None)]
    for name in wanted:
        if errors is None:
            out.append((name, strategy(store, queries, config, name, **restrictions)))
            continue
        try:
            out.append((name, strategy(store, queries, config, name, **restrictions).checkpoint()))
        except (PySparkException, RuntimeError, ValueError) as e:
            errors[name] = str(e)
    if wanted and not out:
        raise RuntimeError(f"all strategies failed: {errors}")
    return out


def fused(store: Store, queries: DataFrame, config: Config = Config(), exclude: DataFrame | None = None, **kw) -> DataFrame:
    """exclude: query_id, message_id."""
    rows = fusion.rrf(*candidates(store, queries, config, **kw), k=config.rrf_k)
    if config.minimum_score is not None:
        rows = rows.where(rows["score"] >= config.minimum_score)
    if exclude is not None:
        rows = rows.join(exclude.select("query_id", F.col("message_id").alias("anchor_message_id")), ["query_id", "anchor_message_id"], "left_anti")
    return rows


def excerpts(store: Store, queries: DataFrame, config: Config = Config(), exclude: DataFrame | None = None, reranker: Callable[[str, list[str]], list[int]] | None = None, **kw) -> DataFrame:
    """Messages of the excerpts within the budget; a reranker gets a larger pool, of which final_top_k are kept."""
    pool = config.final_top_k if reranker is None else max(config.rerank_pool, config.final_top_k)
    ranked = fusion.final_rank(fusion.merge_adjacent(fused(store, queries, config, exclude, **kw)), pool)
    rows = fusion.expand(ranked, store.messages, config.expand_before, config.expand_after, exclude)
    if reranker is not None and pool > config.final_top_k:
        text = fusion.results(rows).select("query_id", "rank", F.col("rank").alias("old"), "content", "score").join(access.bounded(queries, "query_id", "query_text"), "query_id")
        order = models.rerank(text, reranker, config.final_top_k).select("query_id", "old", F.col("rank").alias("new"), F.col("score").alias("new_score"), "fusion_score")
        rows = rows.withColumnRenamed("rank", "old").join(order, ["query_id", "old"]).drop("old", "score").withColumnsRenamed({"new": "rank", "new_score": "score"})
    return fusion.fit_budget(rows, config.max_memory_tokens, config.chars_per_token)


def hybrid(store: Store, queries: DataFrame, config: Config = Config(), metadata: Column | None = None, **kw) -> DataFrame:
    """Results of every query; see Config for limits."""
    return fusion.results(excerpts(store, queries, config, metadata=metadata, **kw))


@dataclass(frozen=True)
class Answer:
    results: DataFrame
    facts: DataFrame
    context: DataFrame


def answer(store: Store, queries: DataFrame, config: Config = Config(), strategies: tuple[str, ...] = STRATEGIES, similar: DataFrame | None = None, exclude: DataFrame | None = None, reranker: Callable[[str, list[str]], list[int]] | None = None, **restrictions) -> Answer:
    """Full results, the graph's facts beside them, and the text to put into a prompt.

    Facts are always found; whether the graph also gives candidates to fusion is config.fuse_graph.
    """
    wanted = tuple(s for s in strategies if s != "graph" or config.fuse_graph)
    kept = excerpts(store, queries, config, exclude, reranker, strategies=wanted, **restrictions)
    found = fusion.results_full(kept, store.participants)
    rows = graph_rows(store, access.require_requester(queries), config, similar, **restrictions)
    facts = graph.grouped_facts(rows, config.graph_top_k or 20)
    line = fusion.fact_line(F.col("subject"), F.col("relation_type"), F.col("object"), F.col("observed_at"), F.col("valid_from"), F.col("valid_until"))
    return Answer(found, facts, fusion.context_block(found, facts.select("query_id", "place", line.alias("line"))))
