"""The registered queries of this subpackage and, where SQL can say the same, their twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import alignment, chat, decontaminate, jaccard, language, lines, mixing, neighbours, pairs, quality, repair, scoring, shards
from ledgerloom.llm.common import Workspace, remainder, ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The tree of sources: a domain for each, and the weights of nodes that differ from 1.
WEB_SOURCES = [f"src{i}" for i in range(10)]
WEIGHTS = {"domain": {"web": 3, "reference": 2}, "lang": {"en": 4, "de": 2, "fr": 2}}


def domain():
    return F.when(F.col("source").isin(WEB_SOURCES), "web").otherwise("reference")


def query(name: str, sql: str | None = None):
    def register(plan):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return plan(spark, sf_dir)

        run.__name__, run.__doc__ = name, plan.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


@query("op1_language_id")
def op1(spark, sf_dir):
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 4) == 2
    model = language.fit(docs.where(~held))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score")


_ESCAPED = r"""replace(replace(replace(replace(coalesce({}, ''), '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':' || chr(10), '\:' || chr(10))"""
_CONVERSATIONS = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
r AS (SELECT conv_id, turn, text, CASE lower(role) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant'
        WHEN 'model' THEN 'assistant' WHEN 'chatgpt' THEN 'assistant' ELSE role END AS role FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(14 + length(""" + _ESCAPED.format("role") + ") + length(" + _ESCAPED.format("text") + """))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id"""
TRAP = "\\### Assistant: </turn> ok"


@query("op2_chat_format", _CONVERSATIONS)
def op2(spark, sf_dir):
    """Every conversation in the chat template, as it reads back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], rows.schema)
    return chat.digests(chat.pieces(chat.canonical_from_rows(rows.unionByName(extra))))


@query("op3_training_order")
def op3(spark, sf_dir):
    """The place of every training sequence and a digest of what its shard holds there."""
    index, folder = shards.materialise(table(spark, sf_dir, "documents"), Workspace(spark, "op3"))
    held = shards.read_back(spark, folder).select("slot", F.sha2("tokens", 256).alias("tokens_sha256"))
    return index.join(held, "slot")


@query("op4_quality")
def op4(spark, sf_dir):
    """A quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = remainder("doc_id", 4) == 2
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    weights = quality.train(docs, labels.where(~held))
    return quality.score(docs, weights).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query("op5_neighbours")
def op5(spark, sf_dir):
    """Ten near neighbours of every hundredth vector."""
    vectors = neighbours.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return neighbours.search(vectors, vectors.where("vec_id % 100 = 0"), Workspace(spark, "op5"))


@query("op6_shingle_join", """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, both_ways.y FROM reach JOIN both_ways ON reach.b = both_ways.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM reach WHERE a = d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id""")
def op6(spark, sf_dir):
    """The near-duplicate component of every document."""
    return jaccard.classes(table(spark, sf_dir, "documents"), Workspace(spark, "op6")).select(
        "doc_id", "n_shingles", "component_id")


@query("op7_lm_scores")
def op7(spark, sf_dir):
    """The log probability of every document under the attention model, and under the word model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = remainder("doc_id", 5) == 1
    return scoring.scores(docs, ~held, Workspace(spark, "op7")).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op8_line_spread", f"""
WITH l AS (SELECT doc_id, coalesce(source, '?') AS site, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, site, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM l),
b AS (SELECT line FROM u WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY line HAVING count(DISTINCT site) >= {lines.MOST_SITES}),
k AS (SELECT u.doc_id, count(*) AS n_lines, count(b.line) AS n_removed,
        coalesce(string_agg(u.line, chr(10) ORDER BY pos) FILTER (b.line IS NULL), '') AS kept
      FROM u LEFT JOIN b ON u.line = b.line GROUP BY u.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
  length(k.kept)::BIGINT AS kept_chars, sha256(k.kept) AS kept_sha256
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id""")
def op8(spark, sf_dir):
    """Every document without the lines that eight sources or more share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return lines.without_boilerplate(docs, Workspace(spark, "op8")).select(
        "doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op9_decontamination")
def op9(spark, sf_dir):
    """Every pair of a document and a benchmark item it holds."""
    found = decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Workspace(spark, "op9"))
    return found.select("doc_id", "item_id", "n_windows", "n_slots", "verbatim")


def _share_out_sql(name: str, nodes: str, parent: list[str], level: str) -> str:
    """The SQL twin of ``mixing.share_out`` as common table expressions ending in ``name``."""
    by = "PARTITION BY " + ", ".join(parent) if parent else ""
    order = f"({by} ORDER BY room::DOUBLE / w::DOUBLE, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    turn_by = ", ".join([*parent, "is_full"])
    given = WEIGHTS.get(level, {})
    weight = "CASE " + level + "".join(f" WHEN '{k}' THEN {v}" for k, v in given.items()) + " ELSE 1 END" if given else "1"
    keys = ", ".join([*parent, level])
    return f"""
{name}_n AS (SELECT {keys}, sum(room) AS room, max(give) AS budget FROM {nodes} GROUP BY {keys}),
{name}_b AS (SELECT * REPLACE (least(budget, sum(room) OVER ({by})) AS budget), ({weight})::HUGEINT AS w FROM {name}_n),
{name}_l AS (SELECT *, budget - coalesce(sum(room) OVER {order}, 0) AS rest,
  sum(w) OVER ({by}) - coalesce(sum(w) OVER {order}, 0) AS ws FROM {name}_b),
{name}_f AS (SELECT *, room * ws <= rest * w AS is_full FROM {name}_l),
{name}_p AS (SELECT *, CASE WHEN is_full THEN room ELSE
  ((budget - coalesce(sum(room) FILTER (is_full) OVER ({by}), 0)) * w) // (sum(w) FILTER (NOT is_full) OVER ({by})) END AS part FROM {name}_f),
{name}_o AS (SELECT *, budget - sum(part) OVER ({by}) AS more, row_number() OVER (PARTITION BY {turn_by} ORDER BY {level}) AS turn FROM {name}_p),
{name} AS (SELECT {keys}, part + CASE WHEN NOT is_full AND turn <= more AND part < room THEN 1 ELSE 0 END AS give FROM {name}_o)"""


_MIX = f"""
WITH docs AS (SELECT doc_id, md5(coalesce(text, '')) AS key,
  CASE WHEN source IN ({', '.join(f"'{s}'" for s in WEB_SOURCES)}) THEN 'web' ELSE 'reference' END AS domain,
  coalesce(lang, '?') AS lang, coalesce(source, '?') AS source,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
counted AS (SELECT * FROM docs WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, (sum(n_tokens) * {mixing.MOST_EPOCHS})::HUGEINT AS room
  FROM counted GROUP BY ALL),
l0 AS (SELECT *, (sum(tokens) OVER ())::HUGEINT AS give FROM leaves),
{_share_out_sql('g1', 'l0', [], 'domain')},
l1 AS (SELECT l0.* EXCLUDE (give), g1.give FROM l0 JOIN g1 USING (domain)),
{_share_out_sql('g2', 'l1', ['domain'], 'lang')},
l2 AS (SELECT l1.* EXCLUDE (give), g2.give FROM l1 JOIN g2 USING (domain, lang)),
{_share_out_sql('g3', 'l2', ['domain', 'lang'], 'source')},
t AS (SELECT leaves.*, (give // tokens)::INT AS whole, give % tokens AS rest FROM leaves JOIN g3 USING (domain, lang, source)),
placed AS (SELECT counted.*, whole, rest, md5(concat_ws(':', '{mixing.SEED}', whole::VARCHAR, coalesce(doc_id::VARCHAR, ''), key)) AS place
  FROM counted JOIN t USING (domain, lang, source)),
started AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS began FROM placed)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, (whole + (began < rest)::INT)::INT AS copies
FROM started WHERE whole + (began < rest)::INT > 0"""


@query("op10_mixing", _MIX)
def op10(spark, sf_dir):
    """How often every document is drawn for the target mixture."""
    return mixing.draw(table(spark, sf_dir, "documents"), domain(), WEIGHTS, Workspace(spark, "op10")).select(
        "doc_id", "domain", "lang", "source", "n_tokens", "copies")


@query("op11_byte_pairs")
def op11(spark, sf_dir):
    """The subword ids of every document and what they decode to, as digests."""
    back = pairs.decode(pairs.encode(table(spark, sf_dir, "documents")))
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))


@query("op12_alignment")
def op12(spark, sf_dir):
    """The aligned groups of two tokenizers in every document, and how common its links are in all of them."""
    space = Workspace(spark, "op12")
    rows = alignment.aligned(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    stored = space.keep(rows.withColumn("groups_sha256", F.when(F.col("row").isNotNull(), digest)).drop("groups"), "aligned")
    return alignment.scored(stored, space).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


# The checksum's table and its run over the characters of a key; insertions that may stand before an edit; then turn by
# turn the cheapest way to each state (0 nothing, 1 system, 2 user, 3 assistant), and of those the least word.
_REPAIR = """
WITH RECURSIVE crc AS (SELECT list(list_reduce([n] || range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS tab FROM range(256) r(n)),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
kinds AS (SELECT given.*, xor(list_reduce([4294967295] || list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT),
    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind FROM given, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, range(2) t(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM damaged),
rows_ AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' END AS fault,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS before FROM seen),
sums AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id),
put(p, q, k, made) AS (VALUES (0, 0, 0, []), (0, 2, 1, ['user:']), (0, 3, 2, ['user:', 'assistant:']), (0, 2, 3, ['user:', 'assistant:', 'user:']),
    (1, 1, 0, []), (1, 2, 1, ['user:']), (1, 3, 2, ['user:', 'assistant:']), (1, 2, 3, ['user:', 'assistant:', 'user:']),
    (2, 2, 0, []), (2, 3, 1, ['assistant:']), (2, 2, 2, ['assistant:', 'user:']), (2, 3, 3, ['assistant:', 'user:', 'assistant:']),
    (3, 3, 0, []), (3, 2, 1, ['user:']), (3, 3, 2, ['user:', 'assistant:']), (3, 2, 3, ['user:', 'assistant:', 'user:'])),
edit(letter, price) AS (VALUES ('D', 4), ('K', 0), ('R', 3)),
best(conv_id, i, state, cost, audit, made) AS (
  SELECT conv_id, 0::BIGINT, 0, 0::BIGINT, '', []::VARCHAR[] FROM sums
  UNION ALL (
    WITH ways AS (
      SELECT b.conv_id, r.i, b.cost + 3 * k + price + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS cost,
        b.audit || repeat('I', k) || letter AS audit,
        CASE WHEN letter = 'D' THEN q WHEN letter = 'R' THEN CASE q WHEN 2 THEN 3 ELSE 2 END
          WHEN left(role, 1) = 's' AND q = 0 THEN 1 WHEN left(role, 1) = 'u' AND q <> 2 THEN 2 WHEN left(role, 1) = 'a' AND q = 2 THEN 3 END AS state,
        list_concat(b.made, list_concat(put.made, CASE letter WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text]
          ELSE [CASE q WHEN 2 THEN 'assistant:' ELSE 'user:' END || text] END)) AS made
      FROM best b JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1 JOIN put ON put.p = b.state, edit
      WHERE letter = 'D' OR fault IS NULL OR fault = 'truncated')
    SELECT conv_id, i, state, cost, audit, made FROM ways WHERE state IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY conv_id, i, state ORDER BY cost, audit) = 1)),
ends AS (SELECT b.conv_id, cost + 3 * k AS cost, audit || repeat('I', k) AS audit, list_concat(b.made, put.made) AS made
  FROM best b JOIN sums s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.n = b.i JOIN put ON put.p = b.state WHERE put.q IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY b.conv_id ORDER BY cost + 3 * k, audit || repeat('I', k)) = 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM c.conv_id"""


@query("op13_conversation_repair", _REPAIR)
def op13(spark, sf_dir):
    """The faults of every damaged conversation, the cheapest repair and a digest of the repaired turns."""
    return repair.repaired(repair.damaged(table(spark, sf_dir, "conversations")))
