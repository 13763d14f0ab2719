"""A query for each operator over the provided tables, and the SQL that says the same.

The tables stand in for what models would extract: turns come from conversations, relations from
events (user, event type, key), entities from parts, vectors from embeddings. Dialogues of roles have turns
of user and assistant alone, so that queries on them leave turns of other roles out (`chunk_speakers` has
all); graph nodes are the users of events, so that queries on nodes read users' vectors (`summary_retrieve` has all).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import temporal, text, vector
from threadloom.operators import chunking, context, dedup, evaluate, extract, graph, ledger, node_index, rerank, retrieve
from threadloom.plans.lineage import cut
from threadloom.plans.memory import folded
from threadloom.sources import convert, corpus

QUERIES: dict = {}
SQL: dict[str, str] = {}

TURNS = """turns as (select cast(conv_id as bigint) as doc_id, 'S' || conv_id // 2 as session_id, strftime(date '2023-01-01' + cast(conv_id % 365 as integer), '%Y/%m/%d') as session_time,
  turn as turn_idx, role as speaker, text as content from conversations where role in ('user', 'assistant'))"""
PAIRS = f"""{TURNS}, begun as (select *, case when speaker = 'assistant' and lag(speaker) over (partition by doc_id order by turn_idx) = 'user' then 0 else 1 end as begins from turns),
  numbered as (select *, sum(begins) over (partition by doc_id order by turn_idx) - 1 as chunk_idx from begun),
  pairs as (select doc_id, session_id, session_time, cast(chunk_idx as bigint) as chunk_idx, count(*) as n_turns, string_agg(upper(speaker[1]) || speaker[2:] || ': ' || content, chr(10) order by turn_idx) as text
    from numbered group by all)"""
RELATIONS = """relations as (select event_id as ordinal, 'u' || user_id as src, event_type as relation, 'k' || regexp_extract(props, '([0-9]+)', 1) as tgt,
  strftime(ts, '%Y/%m/%d') as create_time, 'S' || (user_id % 20) as session_id, event_id as chunk_id, cast(1 + event_id % 10 as bigint) as strength from events)"""
DEDUPED = f"""{RELATIONS}, deduped as (select min(ordinal) as ordinal, arg_min(src, ordinal) as src, arg_min(tgt, ordinal) as tgt, arg_min(relation, ordinal) as relation, arg_min(create_time, ordinal) as create_time,
  arg_max(session_id, ordinal) as session_id, arg_max(chunk_id, ordinal) as chunk_id, max(strength) as strength, count(distinct chunk_id) as n_chunks, array_to_string(list_sort(list(distinct session_id)), ',') as sessions
  from relations group by lower(src), lower(tgt), lower(relation))"""
EDGES = f"""{DEDUPED}, edges as (select min(ordinal) as ordinal, src, tgt, arg_max(relation, ordinal) as relation, arg_max(session_id, ordinal) as session_id, arg_max(create_time, ordinal) as session_time, arg_max(chunk_id, ordinal) as chunk_id
  from deduped group by src, tgt)"""
NODES = f"""{EDGES}, persons as (select src as name, min(ordinal) as ordinal from relations group by src),
  ends as (select name, min(ordinal) as edge_ordinal from (select src as name, ordinal from edges union all select tgt, ordinal from edges) group by name),
  nodes as (select coalesce(p.ordinal, edge_ordinal) as ordinal, e.name, case when p.name is not null then 'person' end as entity_type, p.name is not null as extracted from ends e left join persons p using (name))"""
ENTITIES = f"""{EDGES}, components as (select label as question_id, i, avg(cast(x as double)) as x from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings) group by all),
  centres as (select question_id, list(x order by i) as query_vec from components group by question_id),
  users as (select user_id as vec_id, min(event_id) as ordinal from events group by user_id),
  scored as (select question_id, u.ordinal, 'u' || vec_id as name, round(greatest(0.7 * list_cosine_similarity(cast(embedding as double[]), query_vec), 0), 6) as score from users u join embeddings using (vec_id) cross join centres),
  ranked as (select *, row_number() over (partition by question_id order by score desc, ordinal) - 1 as rank from scored),
  entities as (select * from ranked where rank < 8)"""
POOL = f"""{ENTITIES}, triples as (select question_id, rank, edges.*, 1 / (rank + 1.0) as entity_bonus, round(coalesce(list_cosine_similarity(cast(embedding as double[]), query_vec), 0), 6) as similarity
    from edges join entities on src = name join centres using (question_id) left join embeddings on src = 'u' || vec_id),
  pooled as (select *, round(cast(similarity as double) + 0.2 * cast(entity_bonus as double), 6) as pool_score from triples),
  pool as (select * from (select *, row_number() over (partition by question_id order by pool_score desc, ordinal) - 1 as pool_rank from pooled) where pool_rank < 20),
  sessions as (select question_id, session_id, round(greatest(list_cosine_similarity(cast(embedding as double[]), query_vec), 0), 6) as session_score
    from (select distinct question_id, session_id from pool) join centres using (question_id) join embeddings on session_id = 'S' || vec_id)"""
SIMPLE = f"""{POOL}, simple as (select * from (select *, row_number() over (partition by question_id order by final_score desc, pool_rank) - 1 as final_rank from
  (select pool.*, round(0.7 * similarity::double + 0.3 * coalesce(session_score::double, 0), 6) as final_score from pool left join sessions using (question_id, session_id))) where final_rank < 8)"""
QA = """qa as (select p_partkey as question_id, p_brand as question_type,
  case p_partkey % 4 when 0 then list_reduce(list_reverse(string_split(p_name, ' ')), lambda a, x: a || ' ' || x) when 1 then cast(p_size as varchar) when 2 then upper(p_name) || '!' else p_type end as answer,
  case p_partkey % 4 when 1 then 'The size is ' || p_size || ' units.' when 3 then case when p_partkey % 3 = 0 then '' else 'It is ' || p_name end else 'The part is ' || p_name || '.' end as output from part),
  normal as (select *, lower(trim(answer)) as e, lower(trim(output)) as o, lower(trim(regexp_replace(regexp_replace(answer, '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) as en,
    lower(trim(regexp_replace(regexp_replace(output, '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) as ona from qa),
  judged as (select question_id, question_type, output <> '' as answered, case when answer = '' or output = '' then false when contains(o, e) then true
    when regexp_matches(e, '^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?$') or regexp_matches(e, '^\\d+(\\.\\d+)?\\s*\\w*$') then list_contains(regexp_extract_all(o, '\\d+(?:\\.\\d+)?'), regexp_extract(e, '\\d+(?:\\.\\d+)?'))
    else contains(ona, en) or (len(string_split(en, ' ')) <= 3 and len(list_filter(string_split(en, ' '), lambda x: not list_contains(string_split(ona, ' '), x))) = 0) end as correct from normal)"""


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if SQL can say it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(number):
    return F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), (number % 365).cast("int")), "yyyy/MM/dd")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    session = F.concat(F.lit("S"), F.floor(F.col("conv_id") / 2))  # two documents, of two days, are one session
    return rows.select(F.col("conv_id").cast("long").alias("doc_id"), session.alias("session_id"), day(F.col("conv_id")).alias("session_time"), F.col("turn").alias("turn_idx"), F.col("role").alias("speaker"), F.col("text").alias("content"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("ordinal"), F.concat(F.lit("u"), "user_id").alias("src"), F.col("event_type").alias("relation"), F.concat(F.lit("k"), F.regexp_extract("props", "([0-9]+)", 1)).alias("tgt"),
        F.date_format("ts", "yyyy/MM/dd").alias("create_time"), F.concat(F.lit("S"), (F.col("user_id") % 20)).alias("session_id"), F.col("event_id").alias("chunk_id"), (1 + F.col("event_id") % 10).alias("strength"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_of(dedup.deduplicate_relations(relations(spark, sf_dir)))


def longs(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.col(n).cast("long") for n in names})


@query(f"with {PAIRS} select *, row_number() over (order by doc_id, chunk_idx) - 1 as chunk_id from pairs")
def chunk_turn_pairs(spark, sf_dir):
    return longs(chunking.with_chunk_ids(chunking.pair_turns(turns(spark, sf_dir))), "chunk_idx", "n_turns")


@query(f"""with {TURNS}, numbered as (select *, (row_number() over (partition by doc_id order by turn_idx) - 1) // 2 as chunk_idx from turns)
select doc_id, session_id, session_time, chunk_idx, count(*) as n_turns, string_agg(speaker || ': ' || content, chr(10) order by turn_idx) as text from numbered group by all""")
def chunk_fixed_pairs(spark, sf_dir):
    return longs(chunking.fixed_pairs(turns(spark, sf_dir)), "chunk_idx", "n_turns")


@query("""with words as (select doc_id, list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), ' '), lambda x: x <> '') as w from documents),
starts as (select doc_id, w, unnest(range(0, len(w), 1100)) as start_idx from words where len(w) > 0), cut as (select doc_id, start_idx, w[start_idx + 1 : start_idx + 1200] as w from starts)
select doc_id, start_idx, start_idx + len(w) as end_idx, len(w) as token_count, md5(array_to_string(w, ' ')) as text_md5 from cut""")
def chunk_token_window(spark, sf_dir):
    rows = chunking.token_windows(read(spark, sf_dir, "documents"), 1200, 100)
    return longs(rows, "start_idx", "end_idx", "token_count").select("doc_id", "start_idx", "end_idx", "token_count", F.md5("text").alias("text_md5"))


@query(f"""with {PAIRS} select count(*) as total_chunks, cast(sum(len(list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), ' '), lambda x: x <> ''))) as bigint) as total_tokens,
count(distinct session_id) as sessions, cast(count_if(n_turns >= 2) as bigint) as paired, cast(count_if(n_turns < 2) as bigint) as alone, cast(count_if(trim(text) = '') as bigint) as invalid from pairs""")
def chunk_stats(spark, sf_dir):
    return chunking.chunk_statistics(chunking.pair_turns(turns(spark, sf_dir)))


@query(f"""with {TURNS} select session_id, arg_min(session_time, doc_id * 1000 + turn_idx) as session_time, list_reduce(list(content order by doc_id, turn_idx), lambda a, x: case when contains(a, x) then a else a || chr(10) || chr(10) || x end) as context from turns group by session_id""")
def session_concat(spark, sf_dir):
    return chunking.concat_sessions(turns(spark, sf_dir).select("session_id", "session_time", (F.col("doc_id") * 1000 + F.col("turn_idx")).alias("ordinal"), F.col("content").alias("context")))


@query("""with turns as (select cast(conv_id as bigint) as doc_id, 'S' || conv_id // 2 as session_id, upper(role[1]) || role[2:] as speaker, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) as content from conversations),
numbered as (select *, (row_number() over (partition by doc_id order by turn) - 1) // 2 as chunk_idx from turns),
chunks as (select doc_id, session_id, chunk_idx, count(*) as n_turns, string_agg(speaker || ': ' || content, chr(10) order by turn) as text from numbered group by all)
select *, row_number() over (order by doc_id, chunk_idx) - 1 as chunk_id from chunks""")
def chunk_speakers(spark, sf_dir):
    """All turns of all conversations as a dialogue of named speakers, from flattened contexts to numbered chunks."""
    said = F.array_sort(F.collect_list(F.struct("turn", F.initcap("role").alias("speaker"), F.col("text").alias("content"))))
    rows = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("long").alias("doc_id")).agg(said.alias("t"))
    session = F.concat(F.lit("S"), F.floor(F.col("doc_id") / 2))
    sessions = rows.select("doc_id", session.alias("session_id"), F.lit("").alias("session_time"), corpus.flatten_turns(F.col("t"), "speaker", "content").alias("context"))
    return longs(chunking.with_chunk_ids(chunking.dialogue_chunks(sessions, "speakers")).drop("session_time"), "chunk_idx", "n_turns")


def flattened(spark, sf_dir) -> DataFrame:
    """Sessions with their turns in one string."""
    rows = turns(spark, sf_dir).groupBy("doc_id", "session_id", "session_time").agg(F.array_sort(F.collect_list(F.struct("turn_idx", "speaker", "content"))).alias("t"))
    return rows.select("doc_id", "session_id", "session_time", corpus.flatten_turns(F.col("t"), "speaker", "content").alias("context"))


@query(f"""with {TURNS} select doc_id, session_id, session_time, row_number() over (partition by doc_id order by turn_idx) - 1 as turn_idx, speaker, trim(regexp_replace(content, '\\s+', ' ', 'g')) as content from turns""")
def parse_turns(spark, sf_dir):
    return longs(chunking.parse_turns(flattened(spark, sf_dir)), "turn_idx")


def replies(spark, sf_dir) -> DataFrame:
    r = relations(spark, sf_dir).withColumn("given", F.when(F.col("ordinal") % 7 == 0, "x").otherwise(F.col("strength").cast("string")))
    record = F.concat(F.lit('("relationship"|'), F.concat_ws("|", "create_time", "session_id", "src", "tgt", "relation", "given"), F.lit(")"))
    entity = lambda c, kind, *more: F.concat(F.lit('("entity"|"'), c, F.lit(f'"|{kind}'), *more, F.lit(")"))
    return r.select("ordinal", F.concat_ws("##", entity("src", "person", F.lit("|of "), F.col("session_id")), entity("tgt", "object"), record, F.lit("END"), F.lit("")).alias("reply"))


@query(f"""with {RELATIONS} select ordinal, src as entity, 'person' as type, 'of ' || session_id as description from relations union all select ordinal, tgt, 'object', '' from relations""")
def parse_entities(spark, sf_dir):
    return extract.parse_entities(replies(spark, sf_dir))


@query(f"""with {RELATIONS} select ordinal, create_time, session_id, src, tgt, relation, case when ordinal % 7 = 0 then 1 else strength end as strength, (case when ordinal % 7 = 0 then 1 else strength end) / 10.0::double as weight from relations""")
def parse_relations(spark, sf_dir):
    return longs(extract.parse_relations(replies(spark, sf_dir)), "strength")


@query("select event_id, strftime(ts, '%Y/%m/%d') as stamped, strftime(ts, '%Y/%m/%d') as named, strftime(ts, '%Y/%m/%d') as edge_time, cast(abs(date_diff('day', cast(ts as date), date '2024-01-15')) as double) as gap from events")
def date_normalise(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    stamped = temporal.date_prefix(F.date_format("ts", "yyyy/MM/dd (EEE) HH:mm"))
    named = temporal.named_date(F.date_format("ts", "'1:56 pm on' d MMMM, yyyy"))
    edge = temporal.edge_time(F.lit(""), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.array(F.lit("2030/01/01")))
    return e.select("event_id", stamped.alias("stamped"), named.alias("named"), edge.alias("edge_time"), temporal.day_gap(edge, F.lit("2024/1/15")).alias("gap"))


@query("select user_id, array_to_string(list_sort(list_distinct(list('D' || (event_id % 30)))), ',') as sessions from events group by user_id")
def evidence_sessions(spark, sf_dir):
    marks = F.concat(F.lit("D"), F.col("event_id") % 30, F.lit(":"), F.regexp_extract("props", "([0-9]+)", 1))
    # of each event by itself, so that a user's row holds sessions and not events
    each = read(spark, sf_dir, "events").select("user_id", F.explode_outer(text.evidence_sessions(F.array(marks))).alias("session"))
    return each.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("session")), ",").alias("sessions"))


@query(f"""with {TURNS}, flat as (select any_value(session_id) as session_id, doc_id as conv_id, any_value(session_time) as session_time, string_agg('"' || speaker || '": "' || content || '"', '' order by turn_idx) as context from turns group by doc_id)
select conv_id % 10 as item, row_number() over (partition by conv_id % 10 order by conv_id) - 1 as place, session_id, session_time, context from flat""")
def zip_sessions(spark, sf_dir):
    rows = turns(spark, sf_dir).groupBy(F.col("doc_id").alias("conv_id"), "session_id", "session_time").agg(F.array_sort(F.collect_list(F.struct("turn_idx", "speaker", "content"))).alias("t"))
    # an item is zipped in blocks of at most 50 conversations; their counts tell where each block begins
    rows = rows.withColumn("item", F.col("conv_id") % 10).withColumn("block", F.floor(F.col("conv_id") / 500))
    begins = rows.groupBy("item", "block").agg(F.count("*").alias("n"))
    begins = begins.withColumn("begins", F.sum("n").over(Window.partitionBy("item").orderBy("block")) - F.col("n")).drop("n")
    item = rows.groupBy("item", "block").agg(F.array_sort(F.collect_list(F.struct("conv_id", "session_id", F.concat("session_time", F.lit(" (Mon) 10:00")).alias("date"), "t"))).alias("s"))
    items = item.select("item", "block", F.col("s.session_id").alias("ids"), F.concat("s.date", F.array(F.lit("2030/01/01"))).alias("dates"), F.col("s.t").alias("sessions"))
    zipped = corpus.zip_sessions(items, "ids", "dates", "sessions", ["item", "block"]).join(begins, ["item", "block"])
    return longs(zipped.select("item", (F.col("begins") + F.col("place")).alias("place"), "session_id", "session_time", corpus.flatten_turns(F.col("turns"), "speaker", "content").alias("context")), "place")


_SETS = "list_distinct(string_split(lower(p_name), ' ')) as a, list_distinct(string_split(lower(p_type), ' ')) as b"


@query(f"""with s as (select *, {_SETS} from part), j as (select *, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) as jaccard from s)
select p_partkey, round(jaccard, 6) as jaccard, round(case when lower(p_name) = lower(p_type) then 1 when contains(lower(p_name), lower(p_type)) or contains(lower(p_type), lower(p_name)) then 0.8 when jaccard > 0 then least(1, jaccard + 0.2) else 0 end::double, 6) as similarity from j""")
def entity_jaccard(spark, sf_dir):
    a, b = F.col("p_name"), F.col("p_type")
    return read(spark, sf_dir, "part").select("p_partkey", F.round(text.jaccard(text.token_set(a), text.token_set(b)), 6).alias("jaccard"), F.round(text.name_similarity(a, b), 6).alias("similarity"))


def part_mentions(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("entity"), F.col("p_brand").alias("type"), F.col("p_size").cast("long").alias("chunk_id"))


@query("""select min(p_partkey) as ordinal, arg_min(p_name, p_partkey) as entity, arg_min(p_brand, p_partkey) as type, cast(arg_max(p_size, p_partkey) as bigint) as chunk_id, count(distinct p_size) as n_chunks, count(*) as mentions
from part group by lower(p_brand), list_sort(list_distinct(string_split(lower(p_name), ' ')))""")
def entity_dedup(spark, sf_dir):
    kept, _ = dedup.deduplicate_entities(part_mentions(spark, sf_dir))
    return kept.select("ordinal", "entity", "type", "chunk_id", F.size("chunk_ids").cast("long").alias("n_chunks"), "mentions")


@query("""with recursive named as (select doc_id, lower(text) as name, lower(coalesce(lang, '')) as kind, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) as t from documents where text is not null),
keyed as (select *, case when len(t) = 0 then name else '' end as bare from named),
classes as (select min(doc_id) as id, kind, t, bare from keyed group by kind, t, bare),
links as (select a.id as a, b.id as b from classes a join classes b on a.kind = b.kind and a.id < b.id and least(len(a.t), len(b.t)) >= 0.85 * greatest(len(a.t), len(b.t))
  where len(list_intersect(a.t, b.t)) > 0 and len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.85),
earlier as (select b as id, list(a order by a) as before from links group by b),
linked as (select id, coalesce(before, []) as before, row_number() over (order by id) as k from (select a as id from links union select b from links) left join earlier using (id)),
scan as (select cast(0 as bigint) as k, cast(null as bigint) as id, cast(null as bigint) as leader, cast([] as bigint[]) as leads
  union all select k, id, coalesce(found, id), case when found is null then list_append(leads, id) else leads end
  from (select n.k, n.id, s.leads, list_filter(n.before, lambda x: list_contains(s.leads, x))[1] as found from scan s join linked n on n.k = s.k + 1))
select r.doc_id as ordinal, coalesce(s.leader, c.id) as leader from keyed r join classes c on c.kind = r.kind and c.t = r.t and c.bare = r.bare left join scan s on s.id = c.id""")
def entity_dedup_texts(spark, sf_dir):
    """Leaders of whole texts as names, typed by language: here unequal token sets merge too. The SQL scans the linked texts one after the other."""
    docs = read(spark, sf_dir, "documents").where("text is not null")
    return dedup.entity_leaders(docs.select(F.col("doc_id").alias("ordinal"), F.col("text").alias("entity"), F.col("lang").alias("type"))).select("ordinal", "leader")


@query(f"with {DEDUPED} select *, strength / 10.0::double as weight from deduped")
def relation_dedup(spark, sf_dir):
    names = part_mentions(spark, sf_dir).select(F.col("entity").alias("name"), F.col("entity").alias("canonical")).distinct()
    rows = dedup.deduplicate_relations(dedup.canonical_ends(relations(spark, sf_dir), names))
    return rows.select("ordinal", "src", "tgt", "relation", "create_time", "session_id", "chunk_id", "strength", F.size("chunk_ids").cast("long").alias("n_chunks"), F.array_join("session_ids", ",").alias("sessions"), "weight")


@query(f"""with {RELATIONS}, rewritten as (select * replace (case when src = 'u' || (cast(src[2:] as bigint) // 2 * 2) then src else 'u' || (cast(src[2:] as bigint) // 2 * 2) end as src, 'k' || (cast(tgt[2:] as bigint) // 3 * 3) as tgt) from relations)
select min(ordinal) as ordinal, arg_min(src, ordinal) as src, arg_min(tgt, ordinal) as tgt, arg_min(relation, ordinal) as relation, arg_min(create_time, ordinal) as create_time, arg_max(session_id, ordinal) as session_id, arg_max(chunk_id, ordinal) as chunk_id,
max(strength) as strength, count(distinct chunk_id) as n_chunks from rewritten group by src, tgt, relation""")
def relation_canonical(spark, sf_dir):
    """Relations whose ends are rewritten to other names: users to the even one of two, keys to the first of three."""
    rows = relations(spark, sf_dir)
    number = lambda c, step: F.floor(F.substring(c, 2, 20).cast("long") / step) * step
    users = rows.select(F.col("src").alias("name"), F.concat(F.lit("u"), number("src", 2)).alias("canonical")).distinct()
    keys = rows.select(F.col("tgt").alias("name"), F.concat(F.lit("k"), number("tgt", 3)).alias("canonical")).distinct()
    found = dedup.deduplicate_relations(dedup.canonical_ends(rows, users.union(keys)))
    return found.select("ordinal", "src", "tgt", "relation", "create_time", "session_id", "chunk_id", "strength", F.size("chunk_ids").cast("long").alias("n_chunks"))


@query(f"""with {RELATIONS}, m as (select *, min(ordinal) over (partition by src) as leader, ordinal % 40 as place from relations)
select leader as ordinal, place as chunk_id, session_id, create_time as session_time, src as entity, count(*) as mentions, max(ordinal) as latest from m group by all""")
def entity_provenance(spark, sf_dir):
    """Where each user is named, in rows of chunk, session and time."""
    rows = relations(spark, sf_dir).select("ordinal", F.col("src").alias("entity"), F.lit("person").alias("type"), (F.col("ordinal") % 40).alias("chunk_id"), "session_id", F.col("create_time").alias("session_time"))
    return dedup.entity_provenance(rows)


def persons(spark, sf_dir) -> DataFrame:
    return relations(spark, sf_dir).select("ordinal", F.col("src").alias("entity"), F.lit("person").alias("type"), "chunk_id")


@query(f"with {NODES} select * from nodes")
def graph_nodes(spark, sf_dir):
    return graph.nodes_of(persons(spark, sf_dir), edges(spark, sf_dir)).drop("chunk_id")


@query(f"with {EDGES} select * from edges")
def graph_edges(spark, sf_dir):
    return edges(spark, sf_dir)


@query(f"""with {NODES} select 'nodes' as kind, '' as value, count(*) as n from nodes union all select 'edges', '', count(*) from edges union all select 'node_type', coalesce(entity_type, 'unknown'), count(*) from nodes group by 2
union all select 'edge_type', relation, count(*) from edges group by 2""")
def graph_stats(spark, sf_dir):
    found = edges(spark, sf_dir)
    return graph.statistics(graph.nodes_of(persons(spark, sf_dir), found), found)


@query(f"""with {RELATIONS} select min(ordinal) as ordinal, src, tgt, arg_min(relation, ordinal) as relation, arg_max(session_id, ordinal) as session_id, arg_max(create_time, ordinal) as session_time, arg_max(chunk_id, ordinal) as chunk_id,
max(strength) as strength, max(strength) / 10.0::double as weight, count(distinct chunk_id) as n_chunks, array_to_string(list_sort(list(distinct create_time)), ',') as times from relations group by src, tgt""")
def graph_merge(spark, sf_dir):
    rows = relations(spark, sf_dir)
    half = rows.agg(F.max("ordinal") / 2).first()[0] or 0
    merged = graph.merge_edges(folded(rows.where(F.col("ordinal") < half)), folded(rows.where(F.col("ordinal") >= half)))
    return merged.select("ordinal", "src", "tgt", "relation", "session_id", "session_time", "chunk_id", "strength", "weight", F.size("chunk_ids").cast("long").alias("n_chunks"), F.array_join("session_times", ",").alias("times"))


@query(f"""with {RELATIONS}, halves as (select *, ordinal < (select max(ordinal) / 2 from relations) as early from relations),
met as (select src as name, early, min(ordinal) as ordinal, arg_max(case when strength > 7 then relation else '' end, ordinal) as entity_type, max(chunk_id) as chunk_id, max(strength) > 9 as extracted from halves group by src, early)
select name, coalesce(o.ordinal, n.ordinal) as ordinal, coalesce(nullif(o.entity_type, ''), n.entity_type) as entity_type, coalesce(n.chunk_id, o.chunk_id) as chunk_id, coalesce(o.extracted, false) or coalesce(n.extracted, false) as extracted
from (from met where early) o full join (from met where not early) n using (name)""")
def graph_merge_nodes(spark, sf_dir):
    """Users of the earlier half of the events, brought up to date with those of the later half; a type that was missing is filled in."""
    rows = relations(spark, sf_dir)
    half = rows.agg(F.max("ordinal") / 2).first()[0] or 0
    kind = F.max_by(F.when(F.col("strength") > 7, F.col("relation")).otherwise(""), "ordinal").alias("entity_type")
    met = lambda part: part.groupBy(F.col("src").alias("name")).agg(F.min("ordinal").alias("ordinal"), kind, F.max("chunk_id").alias("chunk_id"), (F.max("strength") > 9).alias("extracted"))
    return graph.merge_nodes(met(rows.where(F.col("ordinal") < half)), met(rows.where(F.col("ordinal") >= half)))


def questions(spark, sf_dir) -> DataFrame:
    """A question for each label: its vector is the label's mean."""
    e = read(spark, sf_dir, "embeddings").select(F.col("label").alias("question_id"), F.posexplode("embedding").alias("i", "x"))
    e = e.groupBy("question_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return e.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("query_vec")).withColumn("query_ord", F.lit(0)).withColumn("query_type", F.lit("unknown"))


def entities(spark, sf_dir) -> DataFrame:
    users = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("vec_id")).agg(F.min("event_id").alias("ordinal"))
    nodes = users.join(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id").withColumn("name", F.concat(F.lit("u"), "vec_id")).withColumn("entity_type", F.lit("person"))
    return retrieve.top_entities(retrieve.entity_scores(questions(spark, sf_dir), nodes), 8)


@query(f"with {ENTITIES} select question_id, ordinal, name, score, rank from entities")
def vector_topk(spark, sf_dir):
    return longs(entities(spark, sf_dir).drop("entity_type"), "rank")


@query(f"""with {ENTITIES}, near as (select question_id, cast(vec_id as bigint) as ordinal, 'v' || vec_id as name,
  round(greatest(0.7 * list_cosine_similarity(cast(embedding as double[]), query_vec) + case when vec_id % 5 = 0 then 0.3 else 0 end, 0), 6) as score from embeddings cross join centres)
select * from (select *, row_number() over (partition by question_id order by score desc, ordinal) - 1 as rank from near) where rank < 8""")
def node_index_topk(spark, sf_dir):
    """The nodes nearest to each question by the index of cells, over all vectors; every fifth node has no type, as the questions."""
    stored = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("ordinal"), F.concat(F.lit("v"), "vec_id").alias("name"), F.when(F.col("vec_id") % 5 != 0, "vector").alias("entity_type"), "embedding")
    found = node_index.scratch_index(spark, stored).search(questions(spark, sf_dir), 8)
    return longs(found.select("question_id", "ordinal", "name", "score", "rank"), "rank")


def pool(spark, sf_dir) -> DataFrame:
    """Candidates by the likeness of their source's vector with the question's; a table, as every reranker reads it more than once."""
    found = retrieve.incident_triples(entities(spark, sf_dir), edges(spark, sf_dir))
    stored = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("u"), "vec_id").alias("src"), "embedding")
    found = found.join(stored, "src", "left").join(questions(spark, sf_dir).select("question_id", "query_vec"), "question_id")
    found = found.withColumn("similarity", F.round(F.coalesce(vector.cosine(F.col("embedding"), F.col("query_vec")), F.lit(0.0)), 6))
    return cut(retrieve.triple_pool(found.drop("embedding", "query_vec"), 8))


@query(f"with {POOL} select question_id, src, tgt, relation, pool_score, pool_rank from pool")
def triple_pool(spark, sf_dir):
    return longs(pool(spark, sf_dir).select("question_id", "src", "tgt", "relation", "pool_score", "pool_rank"), "pool_rank")


def session_scores(spark, sf_dir, found: DataFrame) -> DataFrame:
    """The likeness of each candidate's session's vector with the question's, 0 at least."""
    stored = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("S"), "vec_id").alias("session_id"), "embedding")
    rows = found.select("question_id", "session_id").distinct().join(stored, "session_id").join(questions(spark, sf_dir).select("question_id", "query_vec"), "question_id")
    return rows.select("question_id", "session_id", F.round(F.greatest(vector.cosine(F.col("embedding"), F.col("query_vec")), F.lit(0.0)), 6).alias("session_score"))


def simple(spark, sf_dir) -> DataFrame:
    found = pool(spark, sf_dir)
    return rerank.simple(found, session_scores(spark, sf_dir, found), 0.3, 8)


@query(f"with {SIMPLE} select question_id, src, tgt, final_score, final_rank from simple")
def rerank_simple(spark, sf_dir):
    return longs(simple(spark, sf_dir).select("question_id", "src", "tgt", "final_score", "final_rank"), "final_rank")


@query(f"""with {POOL}, weighed as (select pool.*, round({0.7 * (1.5 / 1.8)!r}::double * similarity::double + {0.3 * (1.5 / 1.8)!r}::double * coalesce(session_score::double, 0) + {0.8 * (1.5 / 1.8)!r}::double * entity_bonus::double, 6) as final_score from pool left join sessions using (question_id, session_id))
select question_id, src, tgt, final_score, final_rank from (select *, row_number() over (partition by question_id order by final_score desc, pool_rank) - 1 as final_rank from weighed) where final_rank < 8""")
def rerank_factors(spark, sf_dir):
    """The simple ranking with the bonus of an end's rank as a further factor; all weights are scaled to 1.5 in all."""
    found = pool(spark, sf_dir)
    rows = rerank.simple(found, session_scores(spark, sf_dir, found), 0.3, 8, {"entity_bonus": 0.8})
    return longs(rows.select("question_id", "src", "tgt", "final_score", "final_rank"), "final_rank")


@query(f"""with {POOL}, gaps as (select pool.*, coalesce(session_score::double, 0) as s, cast(abs(date_diff('day', date '2024-01-15', strptime(session_time, '%Y/%m/%d')::date)) as double) as gap from pool left join sessions using (question_id, session_id)),
scored2 as (select g.*, round((0.3 * case when s = 0 then 0.01 else s end + 0.7 * similarity::double) * exp(-pow(gap / greatest(median(gap) over (partition by question_id), 1.0), 0.5)), 6) as final_score from gaps g)
select question_id, src, tgt, final_score, final_rank from (select *, row_number() over (partition by question_id order by final_score desc, pool_rank) - 1 as final_rank from scored2) where final_rank < 8""")
def rerank_temporal(spark, sf_dir):
    found = pool(spark, sf_dir).withColumn("question_time", F.lit("2024/01/15 (Mon) 10:00")).withColumn("timestamp", F.col("session_time"))
    rows = rerank.temporal_rerank(found, session_scores(spark, sf_dir, found), 0.3, 0.5, 8)
    return longs(rows.select("question_id", "src", "tgt", "final_score", "final_rank"), "final_rank")


def event_chunks(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("chunk_id"), F.concat_ws(" ", "event_type", "props").alias("text"))


def fetched(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    best = cut(simple(spark, sf_dir))
    return best, context.chunks_of(best.withColumn("chunk_ids", F.array(F.col("chunk_id"))), event_chunks(spark, sf_dir), 3)


CHUNKS = f"""{SIMPLE}, firsts as (select question_id, chunk_id, min(final_rank) as r from simple group by all), chosen as (select * from (select question_id, chunk_id, row_number() over (partition by question_id order by r, chunk_id) - 1 as chunk_rank from firsts) where chunk_rank < 3),
  fetched as (select question_id, chunk_id, event_type || ' ' || props as text, chunk_rank from chosen left join events on chunk_id = event_id)"""


@query(f"with {CHUNKS} select * from fetched")
def chunk_fetch(spark, sf_dir):
    return longs(fetched(spark, sf_dir)[1], "chunk_rank")


@query(f"""with {CHUNKS}, t as (select question_id, string_agg('(' || src || ', ' || relation || ', ' || tgt || ')', '; ' order by final_rank) as t from simple group by question_id),
c as (select question_id, string_agg('[' || (chunk_rank + 1) || '] ' || text, chr(10) order by chunk_rank) as c from fetched group by question_id)
select question_id, 'Facts: ' || t || chr(10) || 'Passages:' || chr(10) || c || chr(10) || 'Question: Who is near label ' || question_id || '?' as prompt from t join c using (question_id)""")
def retrieve_pipeline(spark, sf_dir):
    """From question vectors to prompts: entities, triples, pool, rerank, chunks, assembly."""
    best, chunks = fetched(spark, sf_dir)
    asked = best.select("question_id").distinct().withColumn("question", F.concat(F.lit("Who is near label "), "question_id", F.lit("?")))
    return context.prompts(asked, best, chunks)


@query(f"""with {PAIRS}, cut as (select *, list_filter(string_split(text, chr(10)), lambda x: starts_with(trim(x), 'User:')) as l, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: trim(x)), lambda x: length(x) > 10 and not starts_with(lower(x), 'assistant')) as s from pairs)
select doc_id, chunk_idx, case when len(l) > 0 then array_to_string(list_transform(l, lambda x: trim(trim(x)[6:])), ' ') when len(s) > 0 then array_to_string(s[1:2], '. ') when length(text) > 200 then text[1:200] || '...' else text end as said from cut""")
def user_utterances(spark, sf_dir):
    return longs(chunking.pair_turns(turns(spark, sf_dir)).select("doc_id", "chunk_idx", context.user_utterances(F.col("text")).alias("said")), "chunk_idx")


@query("select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as summary from conversations group by conv_id")
def summary_text_map(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    pair = lambda kind, v: F.struct(F.concat(F.lit(f"{kind}_"), F.col("turn") + 1).alias("key"), F.col(v).alias("value"))
    rows = c.withColumn("e", F.explode(F.array(pair("theme", "role"), pair("summary", "text")))).groupBy("conv_id").agg(F.map_from_entries(F.collect_list("e")).alias("context"))
    return rows.select("conv_id", context.summary_text(F.col("context")).alias("summary"))


def results(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey") % 4
    answer = F.when(k == 0, F.array_join(F.reverse(F.split("p_name", " ")), " ")).when(k == 1, F.col("p_size").cast("string")).when(k == 2, F.concat(F.upper("p_name"), F.lit("!"))).otherwise(F.col("p_type"))
    third = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("It is "), "p_name"))
    output = F.when(k == 1, F.concat(F.lit("The size is "), F.col("p_size").cast("string"), F.lit(" units."))).when(k == 3, third).otherwise(F.concat(F.lit("The part is "), "p_name", F.lit(".")))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"), F.col("p_brand").alias("question_type"), answer.alias("answer"), output.alias("output"))


@query(f"with {QA} select question_id, answered, correct from judged")
def answer_match(spark, sf_dir):
    return evaluate.judged(results(spark, sf_dir)).select("question_id", "answered", "correct")


_METRICS = "count(*) as total_questions, cast(count_if(answered) as bigint) as answered_questions, cast(count_if(correct) as bigint) as correct_answers, round(count_if(correct) / count(*), 6) as accuracy, round(count_if(answered) / count(*), 6) as answer_rate"


@query(f"with {QA} select {_METRICS} from judged")
def eval_accuracy(spark, sf_dir):
    return evaluate.metrics(evaluate.judged(results(spark, sf_dir)))


@query(f"with {QA} select question_type, {_METRICS} from judged group by question_type")
def eval_by_type(spark, sf_dir):
    return evaluate.metrics(evaluate.judged(results(spark, sf_dir)), "question_type")


@query("""with s as (select user_id, list('S' || (event_id % 20)) as origin, list(distinct 'S' || (cast(regexp_extract(props, '([0-9]+)', 1) as bigint) % 20)) as found from events group by user_id)
select user_id, round(len(list_filter(origin, lambda x: list_contains(found, x))) / len(origin), 6) as recall from s""")
def session_recall(spark, sf_dir):
    found = F.concat(F.lit("S"), F.regexp_extract("props", "([0-9]+)", 1).cast("long") % 20)
    rows = read(spark, sf_dir, "events").select("user_id", F.concat(F.lit("S"), F.col("event_id") % 20).alias("origin"), found.alias("found"))
    return evaluate.session_recall_by(rows, "user_id").select("user_id", F.round("recall", 6).alias("recall"))


def calls(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.concat(F.lit("m"), F.col("user_id") % 5).alias("model"), text.token_estimate(F.col("props")).alias("prompt_tokens"), (F.col("event_id") % 50).alias("completion_tokens"), F.abs("value").alias("seconds"))
    prices = spark.createDataFrame([(f"m{k}", 0.5 + k, 1.5 + k) for k in range(4)], ledger.PRICES)
    return ledger.costs(rows, prices)


CALLS = """calls as (select event_type as stage, greatest(1, length(props) // 4) as p, event_id % 50 as c, abs(value) as seconds, case when user_id % 5 < 4 then (greatest(1, length(props) // 4) * (0.5 + user_id % 5) + (event_id % 50) * (1.5 + user_id % 5)) / 1000 else 0 end::double as cost from events)"""


@query(f"""with {CALLS}, c as (select *, case when stage < 'm' then 'build' else 'query' end as phase, case when p % 3 = 0 then 'failed' end as error from calls),
r as (select phase, stage, count(*) as calls, cast(sum(p) as bigint) as prompt_tokens, cast(sum(c) as bigint) as completion_tokens, sum(seconds) as s, sum(cost) as cost, count(error) as errors from c group by grouping sets ((phase, stage), (phase), ()))
select phase, stage, calls, prompt_tokens, completion_tokens, round(s, 4) as seconds, round(cost, 4) as cost, errors, round(100 * s / (select sum(seconds) from c), 4) as percent from r""")
def report_rollups(spark, sf_dir):
    """All calls by stage, by phase and over all, by grouping sets."""
    rows = calls(spark, sf_dir).withColumn("phase", F.when(F.col("stage") < "m", "build").otherwise("query")).withColumn("error", F.when(F.col("prompt_tokens") % 3 == 0, "failed"))
    return ledger.rollups(rows).withColumns({c: F.round(c, 4) for c in ("seconds", "cost", "percent")})


@query(f"with {CALLS} select stage, count(*) as calls, cast(sum(p) as bigint) as prompt_tokens, cast(sum(c) as bigint) as completion_tokens, round(sum(cost), 4) as cost from calls group by stage")
def token_cost(spark, sf_dir):
    return ledger.by_stage(calls(spark, sf_dir)).select("stage", "calls", "prompt_tokens", "completion_tokens", F.round("cost", 4).alias("cost"))


@query(f"with {CALLS} select stage, round(sum(seconds), 4) as seconds, round(avg(seconds), 4) as mean_seconds, round(100 * sum(seconds) / sum(sum(seconds)) over (), 4) as percent from calls group by stage")
def stage_time(spark, sf_dir):
    return ledger.by_stage(calls(spark, sf_dir)).select("stage", *[F.round(c, 4).alias(c) for c in ("seconds", "mean_seconds", "percent")])


@query(f"with {QA} select question_id, cast(sum(correct::int) over w as bigint) as right_so_far, round(sum(correct::int) over w / count(*) over w, 6) as accuracy_so_far from judged window w as (partition by question_type order by question_id)")
def running_accuracy(spark, sf_dir):
    order = Window.partitionBy("question_type").orderBy("question_id")
    return evaluate.running_accuracy(evaluate.judged(results(spark, sf_dir)), order).select("question_id", "right_so_far", "accuracy_so_far")


@query("""with nodes as (select min(p_partkey) as ordinal, p_brand || ' ' || p_type as name from part group by 2), q as (select distinct p_brand as question_id from part),
found as (select question_id, ordinal, name, row_number() over (partition by question_id order by ordinal, name) - 1 as rank from q join nodes on contains(lower(name), lower(question_id))) select question_id, name, rank from found where rank < 5""")
def name_fallback(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    nodes = part.groupBy(F.concat_ws(" ", "p_brand", "p_type").alias("name")).agg(F.min("p_partkey").alias("ordinal")).withColumn("entity_type", F.lit("part"))
    asked = part.select(F.col("p_brand").alias("question_id"), F.lit(0).alias("query_ord"), F.col("p_brand").alias("query_name")).distinct()
    return longs(retrieve.name_fallback(asked, nodes, 5), "rank")


@query("""with t as (select p_partkey, p_type, p_brand, string_split(p_type, ' ') as w from part), nodes as (select min(p_partkey * 4 + k) as ordinal, name from (select p_partkey, 0 as k, p_type as name from t union all select p_partkey, 1, w[1] from t
  union all select p_partkey, 2, w[len(w)] from t union all select p_partkey, 3, p_type || ' of ' || p_brand from t) group by name),
asked as (select cast(p_size as bigint) as question_id, p_partkey as query_ord, lower(p_type) as q from part),
met as (select question_id, name, min({'o': query_ord, 'p': case when q = lower(name) then 0 else 1 end, 'n': ordinal}) as met_at from asked join nodes on contains(q, lower(name)) or contains(lower(name), q) group by all)
select question_id, name, rank from (select *, row_number() over (partition by question_id order by met_at, name) - 1 as rank from met) where rank < 5""")
def name_fallback_both_ways(spark, sf_dir):
    """Nodes by name where names of queries lie within those of nodes and the other way round."""
    part = read(spark, sf_dir, "part")
    words = F.split("p_type", " ")
    names = F.array(F.col("p_type"), words[0], F.element_at(words, -1), F.concat_ws(" of ", "p_type", "p_brand"))
    nodes = part.select("p_partkey", "p_type", F.posexplode(names).alias("k", "name")).groupBy("name").agg(F.min(F.col("p_partkey") * 4 + F.col("k")).alias("ordinal"))
    asked = part.select(F.col("p_size").cast("long").alias("question_id"), F.col("p_partkey").alias("query_ord"), F.upper("p_type").alias("query_name"))
    return longs(retrieve.name_fallback(asked, nodes, 5), "rank")


@query("""with w as (select doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda x: length(x) > 2) as k from documents) select doc_id, len(k) as n_keywords, md5(array_to_string(k, ' ')) as keywords_md5 from w""")
def keyword_tokens(spark, sf_dir):
    found = text.keywords(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n_keywords"), F.md5(F.array_join(found, " ")).alias("keywords_md5"))


@query(f"with {ENTITIES}, names as (select distinct name from entities) select src, tgt, relation, min(chunk_id) as chunk_id from edges where src in (from names) or tgt in (from names) group by all")
def retrieve_incident(spark, sf_dir):
    return retrieve.incident_relations(entities(spark, sf_dir).select("name").distinct(), edges(spark, sf_dir)).drop("phase")


@query(f"with {EDGES} select src, tgt, relation, session_id from edges where session_id in (select 'S' || r_regionkey from region)")
def session_triples(spark, sf_dir):
    sessions = read(spark, sf_dir, "region").select(F.concat(F.lit("S"), "r_regionkey").alias("session_id"))
    return retrieve.session_triples(edges(spark, sf_dir), sessions).select("src", "tgt", "relation", "session_id")


@query(f"""with {POOL}, s as (select *, min(pool_score) over (partition by question_id) as lo, max(pool_score) over (partition by question_id) as hi from pool), x as (select *, case when hi > lo then (pool_score - lo) / (hi - lo) else 1 end as z from s)
select question_id, src, tgt, case when z >= 2.0::double / 3 then 'high' when z >= 1.0::double / 3 then 'medium' else 'low' end as bucket from x""")
def visual_buckets(spark, sf_dir):
    return retrieve.visual_buckets(pool(spark, sf_dir), "pool_score").select("question_id", "src", "tgt", "bucket")


@query(f"""with {SIMPLE}, shown as (select *, min(final_score) over (partition by question_id) as lo, max(final_score) over (partition by question_id) as hi from simple where final_rank < 6), x as (select *, case when hi > lo then (final_score - lo) / (hi - lo) else 1 end as z from shown)
select question_id, src, tgt, final_rank, case when z >= 2.0::double / 3 then 'high' when z >= 1.0::double / 3 then 'medium' else 'low' end as bucket, final_rank < 3 as in_table from x""")
def visual_triples(spark, sf_dir):
    """The first six triples of each question's answer, cut by score among themselves, three of them for the table."""
    return longs(retrieve.visual_triples(simple(spark, sf_dir), 6, 3).select("question_id", "src", "tgt", "final_rank", "bucket", "in_table"), "final_rank")


@query(f"""with {ENTITIES}, met as (select e.question_id, e.rank as place, 0 as phase, x.* from edges x join entities e on x.tgt = e.name union all select e.question_id, e.rank, 1, x.* from edges x join entities e on x.src = e.name),
once as (select * from met qualify row_number() over (partition by question_id, src, tgt, relation order by place, phase, ordinal) = 1)
select question_id, src, tgt, relation, chunk_id, rank from (select *, row_number() over (partition by question_id order by place, phase, ordinal, src, tgt, relation) - 1 as rank from once) where rank < 5""")
def relations_of(spark, sf_dir):
    names = entities(spark, sf_dir).select("question_id", F.col("rank").alias("query_ord"), "name")
    return longs(retrieve.relations_of(names, edges(spark, sf_dir), 5).select("question_id", "src", "tgt", "relation", "chunk_id", "rank"), "rank")


@query(f"""with {ENTITIES}, named as (select distinct name from entities) select distinct chunk_id from edges where chunk_id is not null and (src in (from named) or tgt in (from named))""")
def relation_chunks(spark, sf_dir):
    return context.chunk_ids_of(retrieve.incident_relations(entities(spark, sf_dir).select("name").distinct(), edges(spark, sf_dir)))


@query(f"""with {RELATIONS}, dealt as (select *, ordinal < (select max(ordinal) / 2 from relations) as early from relations), pairs as (select src, tgt, bool_or(early) as old, bool_or(not early) as new from dealt group by all),
ends as (select src as name, early from dealt union all select tgt, early from dealt), names as (select name, bool_or(early) as old, bool_or(not early) as new from ends group by name)
select 'edges' as kind, count_if(not old) as added, count_if(old) as merged from pairs where new union all select 'nodes', count_if(not old), count_if(old) from names where new""")
def upsert_counts(spark, sf_dir):
    """How many edges and nodes of the later half of the relations are new to the graph of the earlier half."""
    rows = relations(spark, sf_dir)
    half = rows.agg(F.max("ordinal") / 2).first()[0] or 0
    old, new = folded(rows.where(F.col("ordinal") < half)), folded(rows.where(F.col("ordinal") >= half))
    ends = lambda e: e.select(F.col("src").alias("name")).union(e.select("tgt")).distinct()
    counted = [("edges", graph.upsert_counts(old, new, ["src", "tgt"])), ("nodes", graph.upsert_counts(ends(old), ends(new), ["name"]))]
    parts = [longs(c, "added", "merged").select(F.lit(kind).alias("kind"), "added", "merged") for kind, c in counted]
    return parts[0].union(parts[1])


def key_similarities(spark, sf_dir) -> DataFrame:
    """Similarities of the keys of each conversation, its roles and turns, with three names of each question."""
    c = read(spark, sf_dir, "conversations")
    summaries = c.groupBy(F.concat(F.lit("S"), "conv_id").alias("session_id")).agg(F.array_join(F.collect_list(F.concat_ws(" ", "role", "turn")), ", ").alias("keys"))
    asked = read(spark, sf_dir, "events").select(F.col("event_type").alias("question_id")).distinct()
    asked = asked.select("question_id", F.explode(F.array(F.lit("user"), F.lit("assistant 1"), F.col("question_id"))).alias("query_name"))
    return retrieve.key_entity_similarity(summaries, asked)


@query("""with k as (select conv_id, lower(role) || ' ' || turn as key from conversations), q as (select distinct event_type as question_id from events), names as (select question_id, unnest(['user', 'assistant 1', question_id]) as name from q),
s as (select question_id, 'S' || conv_id as session_id, key, name, len(list_intersect(list_distinct(string_split(key, ' ')), list_distinct(string_split(lower(name), ' ')))) as i, len(list_distinct(list_concat(string_split(key, ' '), string_split(lower(name), ' ')))) as u from k cross join names),
z as (select *, case when key = lower(name) then 1 when contains(key, lower(name)) or contains(lower(name), key) then 0.8 when i > 0 then least(1, i / u + 0.2) else 0 end::double as similarity from s),
r as (select *, row_number() over (partition by question_id, session_id order by similarity desc) as r from z) select question_id, session_id, round(avg(similarity), 6) as session_score from r where r <= 3 group by all""")
def summary_rank(spark, sf_dir):
    return retrieve.summary_scores(key_similarities(spark, sf_dir))


@query(f"""with {ENTITIES}, near as (select question_id, 'S' || vec_id as session_id, round(greatest(list_cosine_similarity(cast(embedding as double[]), query_vec), 0), 6) as score from embeddings cross join centres),
placed as (select *, row_number() over (partition by question_id order by score desc, session_id) - 1 as rank from near) select *, round(0.9 * pow(0.9::double, rank), 6) as session_score from placed where rank < 3""")
def summary_retrieve(spark, sf_dir):
    """The summaries nearest to each question, over all vectors, and their sessions' scores by position."""
    stored = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("S"), "vec_id").alias("session_id"), "embedding")
    found = retrieve.relevant_summaries(questions(spark, sf_dir), stored, 3)
    return longs(retrieve.positional_scores(found.withColumn("place", F.col("rank"))).drop("place"), "rank")


@query("""with k as (select conv_id, lower(role) || ' ' || turn as key from conversations), names as (select question_id, unnest(['user', 'assistant 1', question_id]) as name from (select distinct event_type as question_id from events)),
s as (select question_id, 'S' || conv_id as session_id, key, name, len(list_intersect(list_distinct(string_split(key, ' ')), list_distinct(string_split(lower(name), ' ')))) as i, len(list_distinct(list_concat(string_split(key, ' '), string_split(lower(name), ' ')))) as u from k cross join names),
z as (select *, case when key = lower(name) then 1 when contains(key, lower(name)) or contains(lower(name), key) then 0.8 when i > 0 then least(1, i / u + 0.2) else 0 end::double as similarity from s)
select question_id, session_id, round(avg(similarity), 4) as session_score from z group by all""")
def session_scores_mean(spark, sf_dir):
    """Sessions by the mean over all their keys; keys and names as in `summary_rank`."""
    return retrieve.mean_scores(key_similarities(spark, sf_dir)).withColumn("session_score", F.round("session_score", 4))


@query("""with nodes as (select min(p_partkey) as ordinal, p_name as name, p_brand as entity_type from part group by 2, 3),
found as (select cast(p_size as bigint) as question_id, name, entity_type, ordinal, min(p_partkey) as found_at from part join nodes on lower(p_name) = lower(name) group by all)
select question_id, ordinal, name, entity_type, rank from (select *, row_number() over (partition by question_id order by found_at, ordinal, name) - 1 as rank from found) where rank < 5""")
def node_lookup(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    nodes = part.groupBy(F.col("p_name").alias("name"), F.col("p_brand").alias("entity_type")).agg(F.min("p_partkey").alias("ordinal"))
    names = part.select(F.col("p_size").cast("long").alias("question_id"), F.col("p_partkey").alias("query_ord"), F.upper("p_name").alias("query_name"))
    found = retrieve.nodes_named(names, nodes, 5).join(nodes, ["name", "entity_type"])
    return longs(found.select("question_id", "ordinal", "name", "entity_type", "rank"), "rank")


@query(f"""with {ENTITIES}, near as (select question_id, e.ordinal, src, tgt, session_id, round(coalesce(list_cosine_similarity(cast(embedding as double[]), query_vec), 0), 6) as similarity
  from edges e join centres on session_id in ('S' || question_id, 'S' || (question_id + 10)) left join embeddings on src = 'u' || vec_id)
select * from (select *, row_number() over (partition by question_id order by similarity desc, ordinal) - 1 as rank from near) where rank < 8""")
def session_triples_topk(spark, sf_dir):
    """The edges of each question's two sessions whose source's vector is nearest to the question's."""
    stored = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("u"), "vec_id").alias("src"), "embedding")
    asked = questions(spark, sf_dir)
    sessions = asked.select("question_id", F.explode(F.array("question_id", F.col("question_id") + 10)).alias("s")).select("question_id", F.concat(F.lit("S"), "s").alias("session_id"))
    found = retrieve.session_triples_top(asked, edges(spark, sf_dir).join(stored, "src", "left"), sessions, 8)
    return longs(found.select("question_id", "ordinal", "src", "tgt", "session_id", "similarity", "rank"), "rank")


@query("""with s as (select conv_id, turn + 1 + cast(turn >= 4 as bigint) as number, text as body from conversations), placed as (select *, row_number() over (partition by conv_id order by number) as place from s)
select conv_id, number, body from placed where number = place""")
def numbered_sessions(spark, sf_dir):
    """Conversations as groups of numbered sessions; the fifth is missing, so a group ends with the fourth."""
    number = F.col("turn") + 1 + (F.col("turn") >= 4).cast("long")
    entry = F.struct(F.concat(F.lit("session_"), number).alias("name"), F.col("text").alias("body"))
    groups = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(entry)).alias("conversation"))
    return longs(corpus.numbered_sessions(groups, "conversation", ["conv_id"]).select("conv_id", "number", "body"), "number")


def raw_groups(spark, sf_dir) -> DataFrame:
    """Raw groups of five conversations as numbered sessions, with a question about each; the fourth session of every third group is missing."""
    c = read(spark, sf_dir, "conversations")
    message = F.struct(F.initcap("role").alias("speaker"), "text", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("picture "), "turn")).alias("blip_caption"))
    said = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"]).alias("m"))
    number, date = F.col("conv_id") % 5 + 1, F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), (F.col("conv_id") % 365).cast("int")), "'1:56 pm on' d MMMM, yyyy")
    name = F.concat(F.lit('"session_'), number)
    entry = F.concat(name, F.lit('":'), F.to_json("m"), F.lit(","), name, F.lit('_date_time":"'), date, F.lit('"'))
    kept = ~((number == 4) & (F.floor(F.col("conv_id") / 5) % 3 == 0))
    answer = F.when(F.col("conv_id") % 4 == 0, "").otherwise(F.col("m")[0]["text"])
    evidence = F.array(F.concat(F.lit("D"), number, F.lit(":1")), F.concat(F.lit("D"), F.lit(6) - number, F.lit(":2")), F.concat(F.lit("D"), number, F.lit(":3")))
    asked = F.struct(F.concat(F.lit("What of "), "conv_id", F.lit("?")).alias("question"), answer.alias("answer"), evidence.alias("evidence"), (F.col("conv_id") % 5).alias("category"))
    rows = said.select(F.floor(F.col("conv_id") / 5).alias("item"), "conv_id", F.when(kept, entry).alias("entry"), F.to_json(asked).alias("asked"))
    groups = rows.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("conv_id", "entry", "asked"))).alias("g"))  # five conversations
    listed = lambda c: F.array_join(F.filter(F.transform("g", lambda x: x[c]), lambda x: x.isNotNull()), ",")
    return groups.select("item", F.parse_json(F.concat(F.lit('{"conversation":{"speaker_a":"User",'), listed("entry"), F.lit('},"qa":['), listed("asked"), F.lit("]}"))).alias("v"))


@query("""with m as (select conv_id, string_agg('"' || upper(role[1]) || role[2:] || '": "' || text || case when turn % 3 = 0 then ' (attached is picture ' || turn || ')' else '' end || '"', '' order by turn) as context from conversations group by conv_id),
s as (select conv_id // 5 as item, conv_id % 5 + 1 as number, strftime(date '2023-01-01' + cast(conv_id % 365 as integer), '%Y/%m/%d') as session_time, context from m where not (conv_id % 5 = 3 and conv_id // 5 % 3 = 0)),
p as (select *, row_number() over (partition by item order by number) as place from s)
select item, number, 'D' || number as session_id, session_time, context from p where number = place""")
def convert_group_sessions(spark, sf_dir):
    """Sessions with ids and dates from raw groups of open keys; a group ends before the first session that is missing."""
    return longs(convert.group_sessions(raw_groups(spark, sf_dir)), "item", "number")


@query("""with c as (select conv_id, arg_min(text, turn) as said from conversations group by conv_id), x as (select *, conv_id % 5 + 1 as k from c)
select conv_id // 5 as item, row_number() over (partition by conv_id // 5 order by conv_id) - 1 as number, 'What of ' || conv_id || '?' as question, case when conv_id % 4 = 0 or said = '' then 'Context insufficient to answer' else said end as answer,
cast(conv_id % 5 as varchar) as question_type, case when k = 3 then 'D3' else 'D' || k || ',D' || (6 - k) end as origin, case when conv_id % 4 = 0 or said = '' then 'Context insufficient to answer' else said end as label from x""")
def convert_group_questions(spark, sf_dir):
    """Questions with filled answers and distinct origins from the same raw groups."""
    return longs(convert.group_questions(raw_groups(spark, sf_dir)).withColumn("origin", F.array_join("origin", ",")), "item", "number")


@query(f"""with {QA}, said as (select question_type, output <> '' as answered, case question_id % 3 when 0 then 'Yes, it is.' when 1 then 'no' else 'YES' end as reply from qa), judged2 as (select question_type, answered, contains(lower(reply), 'yes') as correct from said)
select question_type, {_METRICS} from judged2 group by question_type""")
def eval_by_judge(spark, sf_dir):
    """Metrics by question type from a judging model's replies."""
    reply = F.when(F.col("question_id") % 3 == 0, "Yes, it is.").when(F.col("question_id") % 3 == 1, "no").otherwise("YES")
    rows = results(spark, sf_dir).withColumn("answered", F.col("output") != "").withColumn("correct", evaluate.verdict(reply))
    return evaluate.metrics(rows, "question_type")


@query(f"""with {CALLS}, s as (select stage, sum(cost) as cost from calls group by stage), r as (select stage, cost, sum(cost) over (order by stage) as so_far, sum(cost) over () as whole from s)
select stage, round(cost, 4) as cost, round(so_far, 4) as cost_so_far, so_far <= 100 as within from r""")
def cost_budget(spark, sf_dir):
    return ledger.within_budget(calls(spark, sf_dir), 100.0).select("stage", F.round("cost", 4).alias("cost"), F.round("cost_so_far", 4).alias("cost_so_far"), "within")


@query(f"with {QA} select question_id, contains(lower(trim(output)), lower(trim(answer))) as contained, case when length(output) > 20 then output[1:20] || '...' else output end as shown, trim(regexp_replace(output, '\\s+', ' ', 'g')) as plain from qa")
def answer_texts(spark, sf_dir):
    """Containment of answers, and previews and collapsed white space of outputs."""
    out = F.col("output")
    return results(spark, sf_dir).select("question_id", text.contains_match(F.col("answer"), out).alias("contained"), text.preview(out, 20).alias("shown"), text.collapse(out).alias("plain"))
