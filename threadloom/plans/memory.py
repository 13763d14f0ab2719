"""The public face: build a memory from sessions, add to it, ask it questions, measure the answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text, vector
from threadloom.operators import chunking, context, dedup, evaluate, extract, graph, ledger, rerank, retrieve
from threadloom.operators.node_index import NodeIndex
from threadloom.plans.config import Config
from threadloom.plans.lineage import cut
from threadloom.sources import corpus
from threadloom.sources.snapshots import KEYS, Snapshots

_EXTRACT = """List the entities and relations of this dialogue as records.
Write one record for each entity and one for each relation between two of them, parted by ##, and END after the last:
("entity"|name|type, such as person, place, event or thing|what the dialogue says of it)
("relationship"|date as yyyy/MM/dd, or nothing|session id|name of the source|name of the target|the relation in a few words|strength from 1 to 10)
Use names as they stand in the dialogue and the same name for the same thing; who speaks is an entity too.
Dialogue:
"""
_NAME = """List the entities that this question names, with their types, as records.
Parted by ##, and END after the last: ("entity"|name|type). A question that names nothing gets END alone.
Question: """
_NAMED = """List the entities that this text names, with their types, as records.
Parted by ##, and END after the last: ("entity"|name|type). A text that names nothing gets END alone.
Text:
"""
SUMMARISE = """Summarise this session as JSON with session_id, session_time, keys, and a context of themes and summaries.
keys: the words to find it by, in one string, with commas. context: theme_1 and summary_1, theme_2 and summary_2, and so on, one pair for each topic.
{"session_id": "...", "session_time": "...", "keys": "...", "context": {"theme_1": "...", "summary_1": "..."}}
"""
MERGE = """Bring this summary up to date with what was said since, in the same JSON form.
Keep what still holds, change what no longer does, and add pairs of theme and summary for new topics.
Summary so far: """
_ANSWER_FAILED = "No answer could be generated."
QUERY_STAGES = ("query_entities", "answer", "judge")
_PLACES = 24  # bits of an ordinal that number the records of a reply


def folded(relations: DataFrame) -> DataFrame:
    """Edges of relation mentions added one after the other in order of `ordinal`: first name, latest ids, greatest strength."""
    return relations.where("coalesce(src, '') != '' and coalesce(tgt, '') != '' and coalesce(relation, '') != ''").groupBy("src", "tgt").agg(
        F.min("ordinal").alias("ordinal"), F.min_by("relation", "ordinal").alias("relation"), F.max_by("session_id", "ordinal").alias("session_id"),
        F.max_by("create_time", F.when(F.coalesce("create_time", F.lit("")) != "", F.col("ordinal"))).alias("session_time"), F.max_by("chunk_id", "ordinal").alias("chunk_id"),
        F.max("strength").alias("strength"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"), F.array_sort(F.collect_set("session_id")).alias("session_ids"), F.array_sort(F.collect_set("create_time")).alias("session_times"),
    ).withColumn("weight", F.col("strength") / 10.0)


class Memory:
    """generator, embedder: functions without arguments that make a TextGenerator or Embedder in a worker.

    query_generator: a model of its own for questions; the same one, if none is given. Every model call leaves a row in `calls`.
    """

    def __init__(self, spark: SparkSession, base: str, config: Config | None = None, generator=extract.EchoGenerator, embedder=None, query_generator=None):
        self.spark, self.config, self.generator, self.query_generator = spark, config or Config(), generator, query_generator or generator
        dimensions = self.config.embedding_dimensions
        self.embedder = embedder or (lambda: extract.HashEmbedder(dimensions))
        self.store = Snapshots(spark, base, self.config.store_buckets)

    def _replies(self, rows: DataFrame, stage: str, prompt: str = "prompt", out: str = "reply") -> DataFrame:
        """Rows with their replies and `call_error`, kept, since a model asked again may answer otherwise; each call is noted."""
        c, query = self.config, stage in QUERY_STAGES
        limits = extract.Calls(c.concurrency, c.call_timeout, c.call_retries)
        found = cut(extract.generate(rows, prompt, self.query_generator if query else self.generator, out, limits, "call"))
        tokens = F.when(F.col(out) != "", text.token_estimate(F.col(out))).otherwise(0).cast("long")
        noted = found.select(F.lit("query" if query else "build").alias("phase"), F.lit(stage).alias("stage"), F.lit(c.query_model if query else c.model).alias("model"), text.token_estimate(F.col(prompt)).alias("prompt_tokens"), tokens.alias("completion_tokens"), F.col("call_seconds").alias("seconds"), F.col("call_error").alias("error"))
        noted.write.mode("append").parquet(f"{self.store.base}/llm_calls")
        return found.drop("call_seconds")

    def calls(self) -> DataFrame:
        """A row for each model call of this memory so far, in any session: phase, stage, model, prompt_tokens, completion_tokens, seconds, error."""
        path, fs = self.store._fs(f"{self.store.base}/llm_calls")
        return self.spark.read.schema(ledger.CALLS).parquet(str(path)) if fs.exists(path) else self.spark.createDataFrame([], ledger.CALLS)

    def report(self, prices: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Rollups of all calls, one row of totals beside the measures of results, and advice."""
        costs = cut(ledger.costs(self.calls(), prices))
        overview = cut(ledger.overview(costs, self.evaluate(results)))
        return ledger.rollups(costs), overview, ledger.advice(overview)

    def chunks(self, sessions: DataFrame, first: int = 0) -> DataFrame:
        """Turn pairs of dialogues, or windows of words, by `chunk_mode`, numbered from `first` in the order of documents."""
        c, sessions = self.config, corpus.with_doc_id(sessions)
        if c.chunk_mode == "tokens":
            rows = chunking.token_windows(chunking.document_text(sessions), c.window_tokens, c.window_overlap, ("doc_id", "title", "session_id", "session_time"))
            rows = rows.select("doc_id", "title", "session_id", "session_time", F.col("start_idx").alias("chunk_idx"), F.lit(None).cast("int").alias("n_turns"), "text")
        elif c.chunk_mode == "dialogue":
            rows = chunking.dialogue_chunks(sessions, c.dialogue_layout)
        else:
            raise ValueError(f"unknown chunk_mode: {c.chunk_mode}")
        return chunking.with_chunk_ids(rows, first)

    def mentions(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Entity and relation mentions; replies are kept, since a model asked again may answer otherwise.

        Ordinals count by chunk, then by the record's place in the reply.
        """
        asked = chunks.select("chunk_id", "session_id", "session_time", F.concat(F.lit(_EXTRACT), "text").alias("prompt"))
        replies = self._replies(asked, "extraction")
        ordinal = F.shiftleft("chunk_id", _PLACES) + F.col("place")
        entities = extract.parse_entities(replies.select("chunk_id", "reply"), place="place").withColumn("ordinal", ordinal)
        relations = extract.parse_relations(replies.select("chunk_id", F.col("session_time").alias("st"), F.col("session_id").alias("sid"), "reply"), place="place").withColumn("ordinal", ordinal)
        relations = relations.withColumn("create_time", F.coalesce(F.nullif("create_time", F.lit("")), "st")).withColumn("session_id", F.coalesce("sid", "session_id"))
        return entities.drop("place"), relations.drop("st", "sid", "place")

    def named(self, chunks: DataFrame) -> DataFrame:
        """Entities alone, without relations, that a model finds in chunks or texts of any kind (chunk_id, text): chunk_id, place (in the reply), entity, type, and source_text, the beginning of the text."""
        asked = chunks.select("chunk_id", text.preview(F.coalesce("text", F.lit(""))).alias("source_text"), F.concat(F.lit(_NAMED), F.coalesce("text", F.lit(""))).alias("prompt"))
        replies = self._replies(asked, "entities")
        found = extract.parse_query_entities(replies.select("chunk_id", "source_text", "reply"), place="place")
        return found.select("chunk_id", "place", F.col("query_name").alias("entity"), F.col("query_type").alias("type"), "source_text")

    def summaries(self, sessions: DataFrame, old: DataFrame | None = None) -> DataFrame:
        """A summary of each session; one that `old` has is brought up to date with what was added, the rest of `old` stays.

        Parts of a session are told in the order of their documents. Where the model fails, an old summary stays as it is.
        """
        parts = corpus.with_doc_id(sessions)
        whole = chunking.concat_sessions(parts.select("session_id", "session_time", F.col("doc_id").alias("ordinal"), "context"))
        told = F.concat(F.lit("Session ID: "), "session_id", F.lit("\nSession Time: "), F.coalesce("session_time", F.lit("unknown")), F.lit("\nContext: "), F.coalesce("context", F.lit("")))
        prompt = F.concat(F.lit(SUMMARISE), told)
        if old is not None:
            before = old.select("session_id", context.summary_line(F.col("session_id"), F.col("session_time"), F.col("keys"), F.col("context")).alias("before"))
            whole = whole.join(before, "session_id", "left")
            prompt = F.when(F.col("before").isNotNull(), F.concat(F.lit(MERGE), "before", F.lit("\n"), told)).otherwise(prompt)
        replies = self._replies(whole.select("session_id", "session_time", prompt.alias("prompt")), "summaries")
        new = cut(extract.parse_summaries(replies.select("session_id", "session_time", "reply")))
        if old is None:
            return new
        failed = new.where("summary_status = 'failed'").join(old.select("session_id"), "session_id", "left_semi").select("session_id")
        new = new.join(failed, "session_id", "left_anti")
        return old.drop("embedding").join(new.select("session_id"), "session_id", "left_anti").unionByName(new)

    @staticmethod
    def _shown(name: str) -> Column:
        """The text that a row of a table is embedded as."""
        if name == "nodes":
            about = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), "description")).otherwise("")
            return F.concat("name", F.lit(" ("), F.coalesce("entity_type", F.lit("unknown")), F.lit(")"), about)
        return F.concat_ws(" - ", "src", "relation", "tgt") if name == "edges" else context.summary_line(F.col("session_id"), F.col("session_time"), F.col("keys"), F.col("context"))

    def _with_vectors(self, tables: dict[str, DataFrame], old: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """Tables with their vectors; a row whose text is what it was in `old` keeps its vector, and only other texts are embedded."""
        out = {}
        for name, rows in tables.items():
            rows = rows.drop("embedding").withColumn("shown", self._shown(name))
            if old is None:
                out[name] = extract.embed(rows, "shown", self.embedder).drop("shown")
                continue
            had = old[name].where("embedding is not null").select(*KEYS[name], self._shown(name).alias("had"), "embedding")
            rows = cut(rows.join(had, KEYS[name], "left"))
            same = F.coalesce(F.col("had") == F.col("shown"), F.lit(False))
            new = extract.embed(rows.where(~same).drop("had", "embedding"), "shown", self.embedder)
            out[name] = rows.where(same).drop("had").unionByName(new).drop("shown")
        return out

    def build(self, sessions: DataFrame) -> int:
        """A full rebuild: replaces what was stored, once the new version is written."""
        chunks = self.chunks(sessions)
        entities, relations = self.mentions(chunks)
        kept, names = dedup.deduplicate_entities(entities, self.config.merge_threshold)
        edges = graph.edges_of(dedup.deduplicate_relations(dedup.canonical_ends(relations, names)))
        version = max(self.store.versions(), default=-1) + 1
        tables = self._with_vectors({"nodes": graph.nodes_of(kept, edges), "edges": edges, "summaries": self.summaries(sessions)})
        self.store.write({"chunks": chunks} | tables, version)
        self.store.keep_only(version)
        return version

    def insert(self, sessions: DataFrame | None = None) -> int:
        """Brings the memory to the state that `mode` asks for and returns its version: `load` needs one that is stored, `force` builds anew, `add` merges, or builds where nothing is stored."""
        newest, mode = max(self.store.versions(), default=None), self.config.mode
        if mode == "load":
            self.store.load()
            return newest
        if mode not in ("add", "force"):
            raise ValueError(f"unknown mode: {mode}")
        if sessions is None:
            raise ValueError(f"mode {mode} needs sessions")
        return self.build(sessions) if mode == "force" or newest is None else self.add(sessions)

    def added(self, version: int | None = None) -> dict[str, dict[str, int]]:
        """How many nodes and edges the addition that made a version, the newest by default, added and merged; of a build, nothing."""
        return self.store.manifest(max(self.store.versions(), default=None) if version is None else version).get("counts", {})

    def add(self, sessions: DataFrame, stream: str | None = None, batch: int | None = None) -> int:
        """Merges sessions into the newest snapshot and writes the next one. Old names are matched exactly.

        What is read of the old tables and what is written is what the sessions touch: rows of the same names, ends and sessions.
        After `compact_after` additions the tables are folded. A batch of a stream that the newest snapshot holds already is
        left out; the version is returned.
        """
        newest = max(self.store.versions(), default=None)
        manifest = self.store.manifest(newest)
        held = manifest["batches"]
        if stream is not None and batch <= held.get(stream, -1):
            return newest
        batches = held | ({stream: batch} if stream is not None else {})
        return self._merged(newest, manifest, self.chunks(sessions, manifest["next_chunk"]), batches, sessions)

    def add_chunks(self, chunks: DataFrame) -> int:
        """Merges chunks made elsewhere (doc_id, chunk_idx, session_id, session_time, text; title and n_turns if known) as `add` does; they are numbered on, and no summary is touched."""
        newest = max(self.store.versions(), default=None)
        manifest = self.store.manifest(newest)
        given = {"title": F.lit(None).cast("string"), "n_turns": F.lit(None).cast("int")}
        chunks = chunks.withColumns({c: x for c, x in given.items() if c not in chunks.columns})
        rows = chunks.select("doc_id", "title", "session_id", "session_time", F.col("chunk_idx").cast("int").alias("chunk_idx"), "n_turns", "text")
        return self._merged(newest, manifest, chunking.with_chunk_ids(rows.where("coalesce(text, '') != ''"), manifest["next_chunk"]), manifest["batches"])

    def _merged(self, newest: int | None, manifest: dict, chunks: DataFrame, batches: dict[str, int], sessions: DataFrame | None = None) -> int:
        """The version after `newest` with chunks, what is extracted from them, and the summaries of sessions."""
        chunks = cut(chunks)
        entities, relations = self.mentions(chunks)
        kept, names = dedup.deduplicate_entities(entities, self.config.merge_threshold)
        edges = cut(folded(dedup.canonical_ends(relations, names)))
        nodes = cut(graph.nodes_of(kept, edges))
        new = {"nodes": nodes, "edges": edges} | ({"summaries": sessions} if sessions is not None else {})
        old = {name: cut(self.store.touched(name, rows, newest)) for name, rows in new.items()}
        tables = {"nodes": graph.merge_nodes(old["nodes"], nodes), "edges": graph.merge_edges(old["edges"], edges)}
        if sessions is not None:
            tables["summaries"] = self.summaries(sessions, old["summaries"])
        counts = {name: graph.upsert_counts(old[name], new[name], KEYS[name]).first().asDict() for name in ("nodes", "edges")}
        version = 0 if newest is None else newest + 1
        self.store.append({"chunks": chunks} | self._with_vectors(tables, old), version, newest, batches, manifest["next_chunk"] + chunks.count(), counts)
        if max(map(len, self.store.manifest(version)["segments"].values())) > self.config.compact_after:
            version = self.store.compact(version)
        return version

    def _index(self) -> NodeIndex:
        """The index of the newest snapshot's nodes, if it was built."""
        return NodeIndex(self.spark, f"{self.store.base}/index/v={max(self.store.versions(), default=None)}")

    def build_index(self, cells: int | None = None) -> None:
        """Indexes the newest snapshot's nodes, for many questions on a large memory; a later snapshot is searched without it, until this is called again."""
        self._index().build(self.store.load()["nodes"].where("extracted"), cells)

    def asked(self, questions: DataFrame) -> DataFrame:
        """What to search for: the entities that a question names (question_id, query_ord, query_name, query_type, query_vec), else the question itself."""
        prompt = F.concat(F.lit(_NAME), F.coalesce("question", F.lit("")), F.lit("\nAsked at: "), F.coalesce("question_time", F.lit("")))
        replies = self._replies(questions.select("question_id", "question", prompt.alias("prompt")), "query_entities")
        named = cut(extract.parse_query_entities(replies.select("question_id", "reply")))
        rest = questions.join(named, "question_id", "left_anti").select("question_id", F.lit(0).alias("query_ord"), F.col("question").alias("query_name"), F.lit("unknown").alias("query_type"))
        return cut(extract.embed(named.unionByName(rest), "query_name", self.embedder, "query_vec"))

    def session_scores(self, asked: DataFrame, relevant: DataFrame, summaries: DataFrame) -> DataFrame:
        """Scores of each question's relevant sessions: the mean of the three best similarities of a key with what is asked for, or by position."""
        if self.config.summary_scores == "position":
            return retrieve.positional_scores(relevant.withColumn("place", F.col("rank"))).select("question_id", "session_id", "session_score")
        keys = relevant.select("question_id", "session_id").join(summaries.select("session_id", F.explode_outer(text.key_list(F.col("keys"))).alias("key")), "session_id")
        keys = extract.embed(keys, "key", self.embedder, "key_vec")
        similar = retrieve.text_similarity(F.col("key_vec"), F.col("query_vec"), F.col("key"), F.col("query_name"))
        return retrieve.summary_scores(keys.join(asked, "question_id").withColumn("similarity", F.when(F.col("key").isNotNull(), similar)))

    def query(self, questions: DataFrame) -> DataFrame:
        """Answers questions (question_id, question, question_time) in one plan; adds output, error (why the model failed, else null) and top_session_ids. A summary stored without a vector gets one here."""
        c, tables = self.config, self.store.load()
        lacking = tables["summaries"].where("embedding is null").drop("embedding").withColumn("shown", self._shown("summaries"))
        tables["summaries"] = tables["summaries"].where("embedding is not null").unionByName(extract.embed(lacking, "shown", self.embedder).drop("shown"))
        asked, nodes = self.asked(questions), tables["nodes"].where("extracted")
        index, seen = self._index(), asked.where("query_vec is not null")
        found = index.search(seen, c.top_entities) if index.exists() else retrieve.top_entities(retrieve.entity_scores(seen, nodes), c.top_entities)
        found = found.select("question_id", "name", "rank")
        # questions without a vector, or a graph without any: by name
        unseen = asked.join(found, "question_id", "left_anti")
        found = cut(found.unionByName(retrieve.name_fallback(unseen, nodes)))
        whole = extract.embed(questions.select("question_id", "question", F.coalesce("question_time", F.lit("")).alias("question_time")), "question", self.embedder, "query_vec")
        triples = retrieve.incident_triples(found, tables["edges"]).join(whole.select("question_id", "question_time", "query_vec"), "question_id")
        triples = triples.withColumn("similarity", F.round(vector.cosine(F.col("embedding"), F.col("query_vec")), 6)).withColumn("timestamp", F.col("session_time"))
        pool = retrieve.triple_pool(triples.drop("embedding", "query_vec"), c.top_triples)
        scores = told = None
        if c.use_summaries:
            relevant = cut(retrieve.relevant_summaries(asked.where("query_vec is not null"), tables["summaries"], c.top_summaries))
            scores = self.session_scores(asked, relevant, tables["summaries"])
            line = context.summary_line(F.col("session_id"), F.col("session_time"), F.col("keys"), F.col("context"))
            told = relevant.join(tables["summaries"].drop("embedding"), "session_id").select("question_id", "rank", line.alias("line"))
        best = cut(rerank.temporal_rerank(pool, scores, c.summary_weight, c.decay_power, c.top_triples) if c.temporal else rerank.simple(pool, scores, c.summary_weight, c.top_triples))
        chosen = context.with_stubs(context.chunks_of(best, tables["chunks"], c.top_chunks), tables["edges"])
        prompts = context.prompts(questions, best, chosen, told)
        sessions = best.groupBy("question_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("final_rank", "session_id"))), lambda x: x["session_id"])).alias("top_session_ids"))
        replies = self._replies(prompts, "answer", out="output").withColumn("output", F.coalesce(F.nullif("output", F.lit("")), F.lit(_ANSWER_FAILED)))
        return questions.join(replies.select("question_id", "output", F.col("call_error").alias("error")), "question_id", "left").join(sessions, "question_id", "left")

    def evaluate(self, results: DataFrame) -> DataFrame:
        """Accuracy, answer rate and session recall over results with answer, output, origin and top_session_ids."""
        rows = evaluate.judged(results).withColumn("recall", evaluate.session_recall(F.coalesce("origin", F.array()), F.coalesce("top_session_ids", F.array())))
        return evaluate.metrics(rows).crossJoin(rows.agg(F.round(F.avg("recall"), 6).alias("session_recall")))

    def judge(self, results: DataFrame) -> DataFrame:
        """Accuracy by question type as a judging model sees it (question_type, question, answer, output)."""
        prompt = evaluate.judge_prompt(F.col("question_type"), F.col("question"), F.col("answer"), F.col("output"))
        said = self._replies(results.withColumn("judge_prompt", prompt), "judge", "judge_prompt", "verdict")
        rows = said.withColumn("answered", F.coalesce("output", F.lit("")) != "").withColumn("correct", evaluate.verdict(F.col("verdict")))
        return evaluate.metrics(rows, "question_type")
