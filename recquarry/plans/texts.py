"""Registered queries: prompts, messages, example building and formatting."""

from __future__ import annotations

from pyspark.sql import functions as F

from recquarry.functions import arrays as ax, text as tx
from recquarry.operators import clean, examples as ex, layout, sequences as sq, tokens as tk
from recquarry.plans.bindings import INTER, ITEMS, HORIZON, PHASES, Registry, interactions, items, table
from recquarry.plans.sequencing import CHUNK_KEY, CHUNKS, DENSE, SEQ, gap_sql, joined, neg_sql, phase
from recquarry.plans.vectoring import REPAIRED, repaired
from recquarry.sources import files

R = Registry()


def q(text):
    """SQL literal of a text with line breaks."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def flat(messages):
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")


def catalog(spark, sf):
    """Items with their code text; items without a vector have none."""
    return items(spark, sf).join(repaired(spark, sf).select("item_idx", "sem_id"), "item_idx", "left")


CATALOG = f"""{REPAIRED}, {ITEMS}, info AS (SELECT item_id, title, description, coalesce(sem_id, 'NA') AS sem_id FROM items LEFT JOIN repaired USING (item_idx))"""
# targets with both renderings of their histories
TARGETS = f"""{CATALOG}, {SEQ}, blocks AS (
  SELECT t.user_id, t.pos, t.len, t.ts, t.item_id,
    coalesce(string_agg('Title: ' || i.title || chr(10) || 'Description: ' || i.description, chr(10) || chr(10) ORDER BY s.pos), '') AS title_history,
    coalesce(string_agg('Item Index: ' || i.sem_id, chr(10) ORDER BY s.pos), '') AS sem_id_history,
    coalesce(string_agg(i.item_id::VARCHAR, ',' ORDER BY s.pos), '') AS history
  FROM seq t LEFT JOIN seq s ON s.user_id = t.user_id AND s.pos BETWEEN t.pos - 30 AND t.pos - 1 LEFT JOIN info i ON i.item_id = s.item_id
  WHERE t.ts >= TIMESTAMP '2000-01-01' GROUP BY ALL)"""


def message_sql(asked, shown):
    ask = q(tx.PROMPT.format(index=tx.INDEX_NAME[asked]) + "\n")
    return f"'user:' || {ask} || {shown}_history || '|assistant:' || {q(tx.THINK_PREFIX + tx.ANSWER_LABEL[asked])} || info.{asked}"


@R.add("render_chat_example", f"""
WITH {TARGETS} SELECT user_id, blocks.item_id, pos, {message_sql('title', 'title')} AS messages FROM blocks JOIN info ON info.item_id = blocks.item_id
WHERE pos >= 5 AND ts < TIMESTAMP '2000-07-01'""")
def render_chat_example(spark, sf):
    t = sq.train_targets(ex.id_histories(interactions(spark, sf)), *phase("phase1"))
    out = ex.render(ex.with_texts(ex.variants(t, "title", False), catalog(spark, sf)))
    return out.select("user_id", "item_id", "pos", flat("messages").alias("messages"))


@R.add("aux_variants", f"""
WITH {TARGETS}, t AS (SELECT * FROM blocks WHERE pos >= 5 AND ts < TIMESTAMP '2000-07-01')
SELECT user_id, t.item_id, pos, CAST(0 AS INTEGER) AS variant, {message_sql('sem_id', 'sem_id')} AS messages FROM t JOIN info ON info.item_id = t.item_id
UNION ALL SELECT user_id, t.item_id, pos, 1, {message_sql('title', 'sem_id')} FROM t JOIN info ON info.item_id = t.item_id
UNION ALL SELECT user_id, t.item_id, pos, 2, {message_sql('sem_id', 'title')} FROM t JOIN info ON info.item_id = t.item_id""")
def aux_variants(spark, sf):
    t = sq.train_targets(ex.id_histories(interactions(spark, sf)), *phase("phase1"))
    out = ex.render(ex.with_texts(ex.variants(t, "sem_id", False), catalog(spark, sf)))
    return out.select("user_id", "item_id", "pos", "variant", flat("messages").alias("messages"))


VARIANTS = f"""{SEQ}, v AS (SELECT *, epoch_ms(ts) AS ms, unnest([0, 1, 2]) AS variant FROM seq WHERE pos >= 5 AND ts >= TIMESTAMP '2000-01-01' AND ts < TIMESTAMP '2000-07-01'),
picked AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id, ms, variant > 0
  ORDER BY md5('0#' || user_id || '#' || item_id || '#' || ms || '#' || CASE WHEN variant > 0 THEN 'true' ELSE 'false' END || '#' || pos || '#' || variant), pos, variant) AS r FROM v)"""


@R.add("variant_sample", f"WITH {VARIANTS} SELECT user_id, item_id, ms, pos, variant FROM picked WHERE r = 1")
def variant_sample(spark, sf):
    n = layout.number_rows(interactions(spark, sf), ["user_id"], ["ts", "item_id"]).withColumnRenamed("_pos", "pos")
    v = ex.variants(sq.train_targets(n, *phase("phase1")), "sem_id", False)
    v = v.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return sq.sample_variant(v, ["user_id", "item_id", "ms", "aux"], ["pos", "variant"]).select(
        "user_id", "item_id", "ms", "pos", "variant"
    )


# targets of all phases; the first phase keeps five a user
CHOSEN = f"""{SEQ}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, ts < TIMESTAMP '2000-01-01' AND pos >= 5 ORDER BY md5('0#' || user_id || '#' || pos), pos) AS r FROM seq),
chosen AS (
  SELECT user_id, item_id, ts, pos, CASE WHEN ts < TIMESTAMP '2000-01-01' THEN 'pretrain' WHEN ts < TIMESTAMP '2000-07-01' THEN 'phase1'
    WHEN ts < TIMESTAMP '2001-01-01' THEN 'phase2' ELSE 'test' END AS phase
  FROM numbered WHERE CASE WHEN ts < TIMESTAMP '2000-01-01' THEN pos >= 5 AND r <= 5 WHEN ts < TIMESTAMP '2001-01-01' THEN pos >= 5 ELSE pos = len END)"""
CHOSEN_TEXTS = f"""{CATALOG}, {CHOSEN}, blocks AS (
  SELECT t.phase, t.user_id, t.pos, t.ts, t.item_id,
    coalesce(string_agg('Title: ' || i.title || chr(10) || 'Description: ' || i.description, chr(10) || chr(10) ORDER BY s.pos), '') AS title_history,
    coalesce(string_agg('Item Index: ' || i.sem_id, chr(10) ORDER BY s.pos), '') AS sem_id_history,
    coalesce(string_agg(i.item_id::VARCHAR, ',' ORDER BY s.pos), '') AS history
  FROM chosen t LEFT JOIN seq s ON s.user_id = t.user_id AND s.pos BETWEEN t.pos - 30 AND t.pos - 1 LEFT JOIN info i ON i.item_id = s.item_id
  GROUP BY ALL)"""
PICKED = """v AS (SELECT *, epoch_ms(ts) AS ms, unnest([0, 1, 2]) AS variant FROM chosen WHERE phase <> 'test'),
picked AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id, ms, variant > 0
  ORDER BY md5('0#' || user_id || '#' || item_id || '#' || ms || '#' || CASE WHEN variant > 0 THEN 'true' ELSE 'false' END || '#' || pos || '#' || variant), pos, variant) AS r FROM v)"""


def examples(spark, sf, index="title", **options):
    return ex.build_examples(interactions(spark, sf), catalog(spark, sf), PHASES, index, **options)


def shown_example(b):
    return b.select(
        "phase", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "item_id",
        flat("messages").alias("messages"), joined("history").alias("history"), *(c for c in b.columns if c == "aux"),
    )


@R.add("build_examples", f"""
WITH {CHOSEN_TEXTS} SELECT phase, user_id, epoch_ms(ts) AS ms, t.item_id, {message_sql('title', 'title')} AS messages, CASE WHEN phase = 'test' THEN history END AS history
FROM blocks t JOIN info ON info.item_id = t.item_id""")
def build_examples(spark, sf):
    return shown_example(examples(spark, sf))


@R.add("build_examples_sem_id", f"""
WITH {CHOSEN_TEXTS}, {PICKED}, kinds AS (SELECT user_id, pos, variant FROM picked WHERE r = 1 UNION ALL SELECT user_id, pos, 0 FROM chosen WHERE phase = 'test')
SELECT phase, t.user_id, epoch_ms(ts) AS ms, t.item_id, CASE variant WHEN 0 THEN {message_sql('sem_id', 'sem_id')}
  WHEN 1 THEN {message_sql('title', 'sem_id')} ELSE {message_sql('sem_id', 'title')} END AS messages,
  CASE WHEN phase = 'test' THEN history END AS history, variant > 0 AS aux
FROM kinds JOIN blocks t ON t.user_id = kinds.user_id AND t.pos = kinds.pos JOIN info ON info.item_id = t.item_id""")
def build_examples_sem_id(spark, sf):
    return shown_example(examples(spark, sf, "sem_id", keep_aux=True))


@R.add("union_examples", f"""
WITH {CHOSEN}, {PICKED}, {ITEMS}
SELECT 'sequence' AS kind, phase, CASE WHEN variant = 0 THEN 'main' ELSE 'aux' END AS type, count(*) AS n FROM picked WHERE r = 1 GROUP BY 1, 2, 3
UNION ALL SELECT 'sequence', phase, 'main', count(*) FROM chosen WHERE phase = 'test' GROUP BY 1, 2, 3
UNION ALL SELECT 'items', NULL, t, (SELECT count(DISTINCT item_idx // 5) FROM items) FROM (VALUES ('t2i'), ('i2t')) x(t)""")
def union_examples(spark, sf):
    kind = F.when(F.col("aux"), "aux").otherwise("main")
    a = examples(spark, sf, "sem_id", keep_aux=True).select(F.lit("sequence").alias("kind"), "phase", kind.alias("type"))
    b = ex.item_dialogues(catalog(spark, sf)).select(F.lit("items").alias("kind"), F.lit(None).cast("string").alias("phase"), "type")
    return a.unionByName(b).groupBy("kind", "phase", "type").agg(F.count(F.lit(1)).alias("n"))


@R.add("aux_column_prune", f"""
WITH {CATALOG}, {CHOSEN}, past AS (
  SELECT t.phase, t.user_id, t.pos, t.ts, t.item_id, coalesce(string_agg(s.item_id::VARCHAR, ',' ORDER BY s.pos), '') AS history
  FROM chosen t LEFT JOIN seq s ON s.user_id = t.user_id AND s.pos BETWEEN t.pos - 30 AND t.pos - 1 GROUP BY ALL)
SELECT phase, user_id, epoch_ms(ts) AS ms, item_id, CASE WHEN phase = 'test' THEN history END AS history FROM past""")
def aux_column_prune(spark, sf):
    b = examples(spark, sf)
    assert "aux" not in b.columns
    return shown_example(b).drop("messages")


@R.add("write_examples", f"""
WITH {CHOSEN_TEXTS} SELECT 'parts' AS domain, phase, user_id, t.item_id, epoch_ms(ts) AS "timestamp", {message_sql('title', 'title')} AS messages,
  CASE WHEN phase = 'test' THEN history END AS history
FROM blocks t JOIN info ON info.item_id = t.item_id""")
def write_examples(spark, sf):
    path = files.fresh_path(spark, "examples")
    b = examples(spark, sf)
    stamped = b.withColumn("domain", F.lit("parts")).withColumn("timestamp", F.unix_millis(F.col("ts").cast("timestamp"))).drop("ts")
    files.write_examples(stamped, path)
    schema = f"user_id BIGINT, item_id BIGINT, timestamp BIGINT, messages {files.MESSAGES}, history ARRAY<BIGINT>, domain STRING, phase STRING"
    back = spark.read.schema(schema).json(path)
    return back.select(
        "domain", "phase", "user_id", "item_id", "timestamp", flat("messages").alias("messages"), joined("history").alias("history")
    )


GROUPS = f"""{REPAIRED}, {ITEMS}, tot AS (SELECT count(*) AS total FROM items),
info AS (SELECT item_idx, item_id, title, description, coalesce(sem_id, '') AS sem_id FROM items LEFT JOIN repaired USING (item_idx)),
blk AS (SELECT item_idx // 5 AS block, string_agg(item_id::VARCHAR, ',' ORDER BY item_idx) AS item_ids FROM info GROUP BY 1),
draws AS (SELECT block, j AS ord, ('0x' || substr(md5('0#' || block || '#' || j), 1, 8))::BIGINT % total AS idx FROM blk, tot, range(0, 21) r(j)
  UNION ALL SELECT block, 100 + j, ((block + 1) * 5 + j) % total FROM blk, tot, range(0, 10) r(j)),
firsts AS (SELECT block, idx, min(ord) AS ord FROM draws WHERE idx // 5 <> block GROUP BY 1, 2),
chosen AS (SELECT block, idx, row_number() OVER (PARTITION BY block ORDER BY ord) AS at_pos FROM firsts)"""


@R.add("item_groups", f"""
WITH {GROUPS} SELECT blk.block, item_ids, (SELECT string_agg(idx::VARCHAR, ',' ORDER BY at_pos) FROM chosen c WHERE c.block = blk.block AND at_pos <= 5) AS examples FROM blk""")
def item_groups(spark, sf):
    g = sq.item_groups(catalog(spark, sf), 5)
    return g.select("block", joined(F.col("targets.item_id")).alias("item_ids"), joined(F.col("examples.item_idx")).alias("examples"))


def dialogue_sql(kind):
    text = "'Title: ' || title || chr(10) || 'Description: ' || description"
    index = "'Item Index: ' || sem_id"
    ask, answer = (text, index) if kind == "t2i" else (index, text)
    head, tail = (tx.T2I_PROMPT if kind == "t2i" else tx.I2T_PROMPT).split("{examples}")
    return f"""SELECT b.block, '{kind}' AS type, b.item_ids, string_agg('user:' || CASE WHEN i.item_idx % 5 = 0 THEN {q(head)} || e.examples_{kind} || {q(tail)} ELSE '' END
      || {ask} || '|assistant:' || {q(tx.THINK_PREFIX)} || {answer}, '|' ORDER BY i.item_idx) AS messages
    FROM blk b JOIN info i ON i.item_idx // 5 = b.block JOIN shown e ON e.block = b.block GROUP BY ALL"""


@R.add("render_item_id_dialogue", f"""
WITH {GROUPS}, shown AS (SELECT block,
  string_agg('Title: ' || title || chr(10) || 'Description: ' || description || chr(10) || 'Item Index: ' || sem_id, chr(10) ORDER BY at_pos) AS examples_t2i,
  string_agg('Item Index: ' || sem_id || chr(10) || 'Title: ' || title || chr(10) || 'Description: ' || description, chr(10) ORDER BY at_pos) AS examples_i2t
  FROM chosen JOIN info ON info.item_idx = idx WHERE at_pos <= 5 GROUP BY 1)
{dialogue_sql('t2i')} UNION ALL {dialogue_sql('i2t')}""")
def render_item_id_dialogue(spark, sf):
    d = ex.item_dialogues(catalog(spark, sf), 5)
    return d.select("block", "type", "item_ids", flat("messages").alias("messages"))


@R.add("embedding_prompt", f"""
WITH {ITEMS} SELECT item_id, {q(tx.EMBEDDING_INSTRUCTION)} || chr(10) || 'Title: ' || title || chr(10) || 'Description: ' || description AS prompt,
  {q(tx.EMBEDDING_INSTRUCTION)} || chr(10) || 'Title: ' || title AS short_prompt FROM items""")
def embedding_prompt(spark, sf):
    return items(spark, sf).select(
        "item_id", tx.embedding_prompt("title", "description").alias("prompt"), tx.embedding_prompt("title").alias("short_prompt")
    )


@R.add("item_text_concat", """
SELECT l.id AS item_id, CASE WHEN p_partkey IS NULL THEN '' ELSE 'Describe: ' || 'p_name: ' || p_name || CASE WHEN p_size > 10 THEN 'p_brand: ' || p_brand ELSE '' END
  || 'p_size: ' || p_size END AS text
FROM (SELECT p_partkey AS id FROM part UNION ALL SELECT -1 - p_partkey FROM part) l LEFT JOIN part ON p_partkey = l.id""")
def item_text_concat(spark, sf):
    p = table(spark, sf, "part")
    known = p.select(F.col("p_partkey").alias("item_id"), "p_name", F.when(F.col("p_size") > 10, F.col("p_brand")).alias("p_brand"), "p_size")
    ids = p.select(F.explode(F.array(F.col("p_partkey"), -1 - F.col("p_partkey"))).alias("item_id"))
    text = tx.item_text("Describe: ", ["p_name", "p_brand", "p_size"], F.col("p_name").isNotNull())
    return ids.join(known, "item_id", "left").select("item_id", text.alias("text"))


TRUNCATED = r"""
WITH d AS (SELECT doc_id, source AS title, text AS description, regexp_extract_all(source || text, '\s*\S+') AS w FROM documents),
k AS (SELECT *, CASE WHEN len(w) <= 64 THEN title || description ELSE array_to_string(w[1:64], '') END AS kept FROM d),
c AS (SELECT *, CASE WHEN position(title IN kept) > 0 THEN substr(kept, position(title IN kept) + length(title)) ELSE kept END AS rest FROM k)
SELECT doc_id, CASE WHEN length(rest) <> length(description) THEN rest || '...' ELSE description END AS description FROM c"""


@R.add("token_truncate", TRUNCATED)
def token_truncate(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.truncate_description("source", "text", 64).alias("description"))


@R.add("packed_lengths", f"""
WITH {CHUNKS}, {ITEMS}, tk AS (SELECT item_id, [length(w) FOR w IN list_filter(regexp_split_to_array(title || ' ' || description, '\\s+'), lambda x: x <> '')] AS t FROM items),
e AS (SELECT user_id, chunk, generate_subscripts(item_seq, 1) AS i, unnest(item_seq) AS item_id FROM chunks),
l AS (SELECT user_id, chunk, i, t, len(t) AS n FROM e JOIN tk USING (item_id))
SELECT user_id, chunk, string_agg(array_to_string(list_append(t, 0), ','), ',' ORDER BY i) AS ids, string_agg((n + 1)::VARCHAR, ',' ORDER BY i) AS lengths,
  string_agg(array_to_string([p + 8 - n FOR p IN range(0, n + 1)], ','), ',' ORDER BY i) AS positions FROM l GROUP BY 1, 2""")
def packed_lengths(spark, sf):
    # the token id of a word is its length here
    ids = F.transform(tx.words(F.concat_ws(" ", "title", "description")), lambda w: F.length(w).cast("long"))
    tokens = items(spark, sf).select("item_id", ids.alias("tokens"))
    # sequences are cut as ids; tokens are looked up for the entries of a chunk afterwards
    chunks = sq.chunk_sequences(interactions(spark, sf), 25)
    entries = chunks.select("user_id", "chunk", F.posexplode("item_seq").alias("at", "item_id")).join(tokens, "item_id")
    c = entries.groupBy("user_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("at", "tokens"))).alias("e"))
    c = c.select("user_id", "chunk", F.col("e.tokens").alias("item_seq")).withColumn("p", tx.pack_tokens("item_seq", 8, 1))
    return c.select("user_id", "chunk", *(joined(F.col(f"p.{n}")).alias(n) for n in ("ids", "lengths", "positions")))


MD5_ID = "('0x' || substr(md5(w), 1, 7))::BIGINT"
WORDS = "list_filter(regexp_split_to_array({t}, '\\s+'), lambda x: x <> '')"


@R.add("item_text_tokens", f"""
WITH t AS (SELECT p_partkey AS item_id, CASE WHEN p_name IS NULL THEN '' ELSE 'Describe: ' || 'p_name: ' || p_name || CASE WHEN p_size % 4 = 0 THEN '' ELSE 'rest: ' || p_size % 4 END
  || CASE WHEN p_brand = '' THEN '' ELSE 'p_brand: ' || p_brand END END AS x FROM part)
SELECT item_id, array_to_string([{MD5_ID} FOR w IN {WORDS.format(t="x")}][1:6], ',') AS ids FROM t""")
def item_text_tokens(spark, sf):
    p = table(spark, sf, "part").withColumn("rest", F.col("p_size") % 4)
    made = tk.encode_items(p, "Describe: ", ["p_name", "rest", "p_brand"], 6, F.col("p_name").isNotNull())
    return made.select(F.col("p_partkey").alias("item_id"), joined("tokens").alias("ids"))


@R.add("token_truncate_plugin", TRUNCATED)
def token_truncate_plugin(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "text")
    return tk.truncate_descriptions(d, 64, title="source", description="text").select("doc_id", F.col("text").alias("description"))


BATCH_TOKENS, LIST_TOKENS = 4096, 8
PACK_SQL = f"""{DENSE}, {gap_sql("g", "dense", "item_seq")}, {ITEMS},
named AS (SELECT id, [{MD5_ID} FOR w IN {WORDS.format(t="title || ' ' || description")}][1:{LIST_TOKENS}] AS t FROM ids JOIN items ON CAST(item_id AS VARCHAR) = token),
lists AS (SELECT user_id, chunk, item_seq AS pos, {neg_sql("b", CHUNK_KEY, "(len(item_seq) - 1)")} AS neg FROM g),
entries AS (SELECT user_id, chunk, 'pos' AS kind, generate_subscripts(pos, 1) AS i, unnest(pos) AS id FROM lists
  UNION ALL SELECT user_id, chunk, 'neg', generate_subscripts(neg, 1), unnest(neg) FROM lists),
sizes AS (SELECT user_id, chunk, sum(len(t) + 1) AS n FROM entries JOIN named USING (id) GROUP BY 1, 2),
placed AS (SELECT user_id, chunk, (sum(n) OVER (ORDER BY user_id, chunk) - 1) // ({BATCH_TOKENS} - max(n) OVER () + 1) AS batch FROM sizes)"""


def pack_part(kind):
    return f"""(SELECT batch, string_agg(array_to_string(list_append(t, 0), ','), ',' ORDER BY user_id, chunk, i) AS ids, string_agg((len(t) + 1)::VARCHAR, ',' ORDER BY user_id, chunk, i) AS lengths,
  string_agg(array_to_string([p + {LIST_TOKENS} - len(t) FOR p IN range(0, len(t) + 1)], ','), ',' ORDER BY user_id, chunk, i) AS positions,
  '0,' || string_agg(c::VARCHAR, ',' ORDER BY user_id, chunk, i) AS cumulative
  FROM (SELECT *, sum(len(t) + 1) OVER (PARTITION BY batch ORDER BY user_id, chunk, i) AS c FROM entries JOIN named USING (id) JOIN placed USING (user_id, chunk) WHERE kind = '{kind}') GROUP BY 1)"""


@R.add("packed_batches", f"""
WITH {PACK_SQL}, b AS (SELECT batch::BIGINT AS batch, count(*) AS n_sequences FROM placed GROUP BY 1)
SELECT batch, n_sequences, p.ids AS pos_ids, p.lengths AS pos_lengths, p.cumulative AS pos_cumulative, p.positions AS pos_positions,
  coalesce(n.ids, '') AS neg_ids, coalesce(n.lengths, '') AS neg_lengths, coalesce(n.cumulative, '0') AS neg_cumulative, coalesce(n.positions, '') AS neg_positions
FROM b JOIN {pack_part("pos")} p USING (batch) LEFT JOIN {pack_part("neg")} n USING (batch)""")
def packed_batches(spark, sf):
    log = interactions(spark, sf)
    ids = layout.materialize(sq.dense_ids(log, "item_id"))
    sizes = layout.key_sizes(log, ["user_id"])
    chunks = sq.chunk_sequences(sq.encode_ids(log, ids, "item_id", "item"), 25, item="item", sizes=sizes)
    neg = sq.negatives(F.size("item_seq") - 1, ids.count(), "item_seq", "b", "user_id", "chunk")
    # sequences are ids until they are complete; tokens are looked up for their entries
    kinds = F.array(F.struct(F.lit("pos").alias("kind"), F.col("item_seq").alias("ids")), F.struct(F.lit("neg").alias("kind"), neg.alias("ids")))
    lists = chunks.select("user_id", "chunk", F.explode(kinds).alias("l")).select("user_id", "chunk", "l.kind", F.posexplode("l.ids").alias("at", "id"))
    text = F.concat_ws(" ", "title", "description")
    named = ids.join(items(spark, sf).withColumn("token", F.col("item_id").cast("string")), "token")
    named = named.select("id", tk.tokenize(text)["ids"].alias("tokens"))
    entry = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("at", "tokens"))))["tokens"].alias(kind)
    sequences = lists.join(named, "id").groupBy("user_id", "chunk").agg(entry("pos"), entry("neg"))
    b = tk.pack_batches(sequences, ["user_id", "chunk"], BATCH_TOKENS, LIST_TOKENS)
    return b.select("batch", "n_sequences", *(joined(f"{k}_{p}").alias(f"{k}_{p}") for k in ("pos", "neg") for p in ("ids", "lengths", "cumulative", "positions")))


@R.add("generation_prompt", """
WITH m AS (SELECT *, turn = max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
SELECT 'title' AS mode, conv_id, turn, CASE WHEN last THEN 'assistant' ELSE role END AS role, CASE WHEN last THEN 'Recommended Item Title:' ELSE text END AS content FROM m
UNION ALL SELECT 'sem_id', conv_id, turn, CASE WHEN last THEN 'assistant' ELSE role END, CASE WHEN last THEN 'Recommended Item Index: ' ELSE text END FROM m""")
def generation_prompt(spark, sf):
    c = table(spark, sf, "conversations")
    made = [ex.generation_turns(c, m).select(F.lit(m).alias("mode"), "conv_id", "turn", "role", "content") for m in ("title", "sem_id")]
    return made[0].unionByName(made[1])


@R.add("generation_prompt_examples", f"""
WITH {TARGETS} SELECT user_id, 'user:' || {q(tx.PROMPT.format(index='item index') + chr(10))} || sem_id_history || '|assistant:Recommended Item Index: ' AS messages
FROM blocks WHERE ts >= TIMESTAMP '2001-01-01' AND pos = len""")
def generation_prompt_examples(spark, sf):
    b = ex.build_examples(interactions(spark, sf), catalog(spark, sf), PHASES, "sem_id").where("phase = 'test'")
    return b.select("user_id", flat(tx.generation_prompt("messages", "sem_id")).alias("messages"))


@R.add("hit_vector", """
SELECT doc_id, array_to_string([CASE WHEN contains(s, lang) THEN 1 ELSE 0 END FOR s IN string_split(text, '. ')], '') AS hits FROM documents""")
def hit_vector(spark, sf):
    d = table(spark, sf, "documents")
    marks = tx.hit_vector(F.split("text", r"\. "), "lang")
    return d.select("doc_id", F.array_join(F.transform(marks, lambda h: F.when(h, "1").otherwise("0")), "").alias("hits"))


@R.add("beam_truncate_explode", r"""
WITH o AS (SELECT doc_id, string_split(text, '. ')[1:5] AS output FROM documents)
SELECT doc_id, b - 1 AS beam, string_split(regexp_replace(output[b], '^\s+|\s+$', '', 'g'), chr(10))[1] AS text
FROM (SELECT doc_id, output, unnest(range(1, len(output) + 1)) AS b FROM o)""")
def beam_truncate_explode(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.split("text", r"\. ").alias("output"))
    return ex.truncate_outputs(d, ["doc_id"], 5)


@R.add("score_trunc_cutoff", """
SELECT o_orderkey, ceil(o_totalprice / 1000) AS up, floor(o_totalprice / 1000) AS down,
  round_even((o_orderkey % 7) / 2.0::DOUBLE, 0) AS even, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END::BIGINT AS positive FROM orders""")
def score_trunc_cutoff(spark, sf):
    s = F.col("o_totalprice") / 1000
    half = (F.col("o_orderkey") % 7) / F.lit(2.0)
    return table(spark, sf, "orders").select(
        "o_orderkey", ax.truncate_score(s, "ceil").alias("up"), ax.truncate_score(s, "floor").alias("down"),
        ax.truncate_score(half, "around").alias("even"), ax.cut_off("o_totalprice", 200000).alias("positive"),
    )


@R.add("pad_ragged", """
WITH v AS (SELECT vec_id, embedding[1:CAST(vec_id % 8 AS INTEGER)] AS e FROM embeddings)
SELECT vec_id, i - 1 AS pos, CASE WHEN i <= len(e) THEN e[i]::DOUBLE ELSE '-Infinity'::DOUBLE END AS value FROM v, range(1, 9) r(i)""")
def pad_ragged(spark, sf):
    v = table(spark, sf, "embeddings").select(
        "vec_id", F.slice("embedding", F.lit(1), (F.col("vec_id") % 8).cast("int")).alias("e")
    )
    return v.select("vec_id", F.posexplode(ax.pad_ragged("e", 8)).alias("pos", "value")).select(
        "vec_id", F.col("pos").cast("long").alias("pos"), "value"
    )


@R.add("format_floats", """
SELECT o_orderkey, printf('%.4f', o_totalprice / 8) AS eighth, CASE WHEN o_orderkey % 5 <> 0 THEN printf('%.4f', o_totalprice) END AS some FROM orders""")
def format_floats(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 8).alias("eighth"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("some")
    )
    return tx.format_floats(o, 4)
