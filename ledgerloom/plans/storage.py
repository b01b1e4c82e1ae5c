"""Files, tables and streams: written from the given tables, read back, compared.

Folders are new for each run and lie in the session's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import paths, records
from ledgerloom.operators import decisions, numbering
from ledgerloom.operators.onerow import attach
from ledgerloom.plans.catalog import query
from ledgerloom.plans.cleaning import american, day, exact, key, messy_amount, messy_date, total
from ledgerloom.plans.edge import edge
from ledgerloom.plans.entities import AS_OF, Tables, money
from ledgerloom.plans.findings import DAYS, billed, whole
from ledgerloom.plans.scratch import new_folder
from ledgerloom.sources import deltas, files, sinks
from ledgerloom.sources.shared import written_once
from ledgerloom.streaming import events

# ------------------------------------------------------------------ JSON and CSV


def invoice_json(t: Tables) -> DataFrame:
    """Invoices as their files hold them: messy text, either party form, either field name."""
    k, ht = key(), american(total())
    vendor = F.coalesce("vendor", F.lit("Comptoir"))
    inv = t.invoices(paid=False).withColumn("o_orderdate", F.col("date")).withColumn("o_totalprice", F.col("amount"))
    item = F.struct(F.lit("service").alias("description"), F.lit("2").alias("qty"), ht.alias("unit_price"))
    return inv.select(
        F.when(k % 2 == 0, F.col("invoice_id")).alias("invoice_id"), F.when(k % 2 == 1, F.col("invoice_id")).alias("number"),
        messy_date(day()).alias("date"), F.date_format("due_date", "dd/MM/yyyy").alias("due_date"),
        F.when(k % 3 == 0, F.struct(vendor.alias("name"), F.lpad(k.cast("string"), 14, "1").alias("siret"))).alias("vendor"),
        F.when(k % 3 != 0, vendor).alias("supplier"), F.col("client").alias("customer"),
        F.array(item).alias("lines"), messy_amount(total()).alias("subtotal_ht"),
        F.when(k % 2 == 0, 20.0).otherwise(0.2).alias("tax_rate"), F.lower("status").alias("status"))


@query("src_invoice_json", f"""
SELECT invoice_id, date, due_date, coalesce(vendor, 'Comptoir') AS vendor,
       CASE WHEN o_orderkey % 3 = 0 THEN lpad(o_orderkey::VARCHAR, 14, '1') END AS siret, client,
       amount::DOUBLE AS total_ht, 0.2::DOUBLE AS tax_rate, {exact('amount::DOUBLE * (1 + 0.2::DOUBLE)')} AS total_ttc,
       {exact(exact('amount::DOUBLE * (1 + 0.2::DOUBLE)') + ' - amount::DOUBLE')} AS tax_amount,
       'UNKNOWN' AS currency, status, (amount * 2)::DOUBLE AS items_total FROM invoices""")
def _(t):
    folder = new_folder(t.spark, "invoices")
    invoice_json(t).write.json(folder)
    inv = files.read_invoices(t.spark, folder, whole_file=False)
    return inv.select("invoice_id", "date", "due_date", F.col("vendor.name").alias("vendor"), F.col("vendor.siret").alias("siret"),
                      F.col("client.name").alias("client"), "total_ht", "tax_rate", "total_ttc", "tax_amount", "currency",
                      "status", F.get("items", F.lit(0))["total"].alias("items_total"))


def contract_json(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    giving = F.to_json(F.struct(F.col("vendor").alias("name"), F.lit("provider").alias("role")))
    clause = F.to_json(F.struct(F.lit("penalty").alias("type"), F.lit("late fee").alias("text")))
    return t.contracts().select(
        F.when(k % 2 == 0, F.col("contract_id")).alias("contract_id"), F.when(k % 2 == 1, F.col("contract_id")).alias("id"),
        F.concat(F.col("type"), F.lit(" agreement")).alias("title"), F.date_format("start_date", "dd.MM.yyyy").alias("effective_date"),
        F.date_format("end_date", "MMMM d, yyyy").alias("end_date"), american("annual_value").alias("annual_value"),
        F.array(F.lit("Client SA"), giving).alias("parties"), F.array(clause, F.lit("Good faith")).alias("clauses"),
        F.col("auto_renewal"), F.lower("type").alias("category"))


@query("src_contract_json", """
SELECT contract_id, concat(type, ' agreement') AS title, start_date, end_date, vendor, annual_value::DOUBLE AS annual_value,
       auto_renewal, lower(type) AS type, 2::BIGINT AS parties, 'UNKNOWN,PROVIDER' AS roles,
       'PENALTY:late fee,GENERAL:Good faith' AS clauses, 30.0::DOUBLE AS payment_terms_days FROM contracts""")
def _(t):
    folder = new_folder(t.spark, "contracts")
    contract_json(t).write.json(folder)
    c = files.read_contracts(t.spark, folder, whole_file=False)
    return edge(c.select(
        "contract_id", "title", "start_date", "end_date", "vendor", "annual_value", "auto_renewal", "type",
        F.size("parties").alias("parties"), F.array_join(F.transform("parties", lambda p: p["role"]), ",").alias("roles"),
        F.array_join(F.transform("clauses", lambda c: F.concat_ws(":", c["type"], c["description"])), ",").alias("clauses"),
        "payment_terms_days"))


def ledger(t: Tables) -> DataFrame:
    """Ledger lines: one account per part, returned lines on the credit side."""
    k, amount = F.col("l_partkey"), american(money("l_extendedprice"))
    accounts = F.array(*[F.lit(a) for a in ("601", "606", "611", "623", "641", "706")])
    returned = F.col("l_returnflag") == "R"
    ref = F.concat_ws("-", F.lit("L"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return t.read("lineitem").select(
        F.date_format("l_shipdate", "dd/MM/yyyy").alias("date"), F.element_at(accounts, (k % 6 + 1).cast("int")).alias("account"),
        F.lit("Compte").alias("account_name"), F.col("l_returnflag").alias("description"),
        F.when(returned, "").otherwise(amount).alias("debit"), F.when(returned, amount).otherwise("").alias("credit"),
        F.when(F.col("l_orderkey") % 23 == 0, "").otherwise(ref).alias("reference"))


LEDGER_SQL = """
SELECT l_shipdate::DATE AS date, ['601', '606', '611', '623', '641', '706'][l_partkey % 6 + 1] AS account,
       CASE WHEN l_returnflag <> 'R' THEN l_extendedprice::DECIMAL(18,2)::DOUBLE END AS debit,
       CASE WHEN l_returnflag = 'R' THEN l_extendedprice::DECIMAL(18,2)::DOUBLE END AS credit,
       CASE WHEN l_orderkey % 23 <> 0 THEN concat_ws('-', 'L', l_orderkey::VARCHAR, l_linenumber::VARCHAR) END AS reference
FROM lineitem"""


@query("src_ledger_csv", LEDGER_SQL, finance=False)
def _(t):
    folder = new_folder(t.spark, "ledger")
    rows = ledger(t)
    half = F.crc32(F.coalesce("reference", F.lit(""))) % 2 == 0
    rows.where(half).write.option("header", True).csv(folder)
    rows.where(~half).select(*reversed(rows.columns)).write.mode("append").option("header", True).csv(folder)
    return files.read_ledger(t.spark, folder).drop("account_name", "description")


@query("src_entry_json", f"""
SELECT date, account AS account_code, coalesce(debit, 0) AS debit, coalesce(credit, 0) AS credit, reference FROM ({LEDGER_SQL})""",
       finance=False)
def _(t):
    folder = new_folder(t.spark, "entries")
    rows = ledger(t).withColumnsRenamed({"date": "entry_date", "debit": "debit_amount", "reference": "document_ref"})
    rows.drop("account_name").write.json(folder)
    return files.read_entries(t.spark, folder, whole_file=False).select("date", "account_code", "debit", "credit", "reference")


@query("src_discover")
def _(t):
    """Files of the known folders, with type and format."""
    folder = new_folder(t.spark, "drop")
    invoice_json(t).write.json(f"{folder}/invoices")
    ledger(t).write.option("header", True).csv(f"{folder}/accounting")
    return files.discover(t.spark, folder).groupBy("document_type", "format").agg(F.count("*").alias("files"))


@query("src_listing")
def _(t):
    """Every given table file: id, size and class."""
    rows = files.listing(t.spark, t.sf_dir)
    return rows.groupBy("suffix", "format").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("src_route_json", """
SELECT CASE WHEN conv_id % 4 = 3 THEN 'other' WHEN conv_id % 4 = 2 THEN 'accounting_entry'
            WHEN conv_id % 4 = 1 THEN 'contract' ELSE 'invoice' END AS document_type, count(*)::BIGINT AS files
FROM conversations GROUP BY 1""", finance=False)
def _(t):
    """One JSON text per conversation turn, routed by name or by its fields."""
    k = F.col("conv_id") % 4
    body = F.col("text")
    value = (F.when(k == 0, F.to_json(F.struct(body.alias("vendor"))))
             .when(k == 1, F.to_json(F.struct(F.array(body).alias("parties"))))
             .when(k == 2, F.to_json(F.struct(body.alias("entry_id")))).otherwise(F.to_json(F.struct(body.alias("other")))))
    name = F.when((k == 0) & (F.col("turn") % 2 == 0), "Facture.json").otherwise("doc.json")
    kind = files.json_type(name, value)
    return t.read("conversations").select(F.coalesce(kind, F.lit("other")).alias("document_type")).groupBy(
        "document_type").agg(F.count("*").alias("files"))


#: Where the layouts of ``mixed_json`` keep their fields.
MIXED_PATHS = {
    "invoice_id": (["id", "header.number"], "string"), "vendor": (["vendor.name", "vendor", "supplier.company.name", "seller"], "string"),
    "amount": (["totals.net", "amount"], "double"), "due": (["terms.due date", "due_date"], "string")}


def mixed_json(t: Tables) -> DataFrame:
    """Invoices as JSON texts: vendors nested once, flat, nested twice or under another name; every thirtieth cut off."""
    k = F.col("o_orderkey")
    inv = t.invoices(client=False, paid=False)
    vendor, amount = F.coalesce("vendor", F.lit("")), F.col("amount").cast("double")
    due = F.col("due_date").cast("string")
    nested = F.to_json(F.struct(F.col("invoice_id").alias("id"), F.struct(vendor.alias("name")).alias("vendor"),
                                F.struct(amount.alias("net")).alias("totals"), due.alias("due_date")))
    flat = F.to_json(F.struct(F.col("invoice_id").alias("id"), vendor.alias("vendor"), amount.alias("amount"), due.alias("due_date")))
    deep = F.to_json(F.struct(F.struct(F.col("invoice_id").alias("number")).alias("header"), amount.cast("string").alias("amount"),
                              F.struct(F.struct(vendor.alias("name")).alias("company")).alias("supplier"), F.struct(due.alias("due date")).alias("terms")))
    other = F.to_json(F.struct(F.col("invoice_id").alias("id"), F.lit("").alias("vendor"), vendor.alias("seller"), F.lit("n/a").alias("totals"),
                               amount.alias("amount"), F.struct(F.lit(1).alias("days")).alias("terms")))
    text = F.when(k % 4 == 0, nested).when(k % 4 == 1, flat).when(k % 4 == 2, deep).otherwise(other)
    return inv.select(F.when(k % 30 == 0, F.expr("left(invoice_id, 3)")).otherwise(text).alias("value"))


@query("nested_fields", """
SELECT CASE WHEN o_orderkey % 30 <> 0 THEN invoice_id END AS invoice_id, CASE WHEN o_orderkey % 30 <> 0 THEN vendor END AS vendor,
       CASE WHEN o_orderkey % 30 <> 0 THEN amount::DOUBLE END AS amount,
       CASE WHEN o_orderkey % 30 <> 0 AND o_orderkey % 4 <> 3 THEN due_date::DATE::VARCHAR END AS due FROM invoices""")
def _(t):
    """Invoices read from four JSON layouts through one list of dotted paths for each field."""
    folder = new_folder(t.spark, "mixed")
    mixed_json(t).write.text(folder)
    return t.spark.read.text(folder).select(*paths.fields("value", MIXED_PATHS))


def answers(t: Tables) -> DataFrame:
    """Two rounds of answers per contract: a first guess, then the right one."""
    c = t.contracts()
    name = F.concat("contract_id", F.lit(".pdf"))

    def asked(text: str, answer, step: int, n: int):
        return F.struct(F.lit(text).alias("Question"), answer.alias("Answer"), (F.col("s_suppkey") * 100 + step * 50 + n).alias("row_no"))

    rounds = []
    for step in (0, 1):
        vendor = F.lit("Nobody") if step == 0 else F.concat(F.col("vendor"), F.lit("; Client SA"))
        end = F.lit("January 1, 1999") if step == 0 else F.date_format("end_date", "MM/dd/yyyy")
        value = F.lit("$1.00") if step == 0 else F.concat(F.lit("$"), american("annual_value"))
        rounds += [asked("Parties: who signs?", vendor, step, 1), asked("Agreement Date", F.date_format("start_date", "MM/dd/yyyy"), step, 2),
                   asked("Expiration Date", F.coalesce(end, F.lit("n/a")), step, 3), asked("Contract Value", value, step, 4),
                   asked("Auto-Renewal clause", F.when(F.col("auto_renewal"), "Yes, yearly").otherwise("Not mentioned"), step, 5)]
    return c.select(name.alias("Filename"), F.inline(F.array(*rounds)))


ANSWERED = """
SELECT contract_id, vendor, 'SERVICE' AS type, start_date, coalesce(end_date, DATE '1999-01-01') AS end_date,
       annual_value::DOUBLE AS annual_value, auto_renewal, s_suppkey FROM contracts"""


@query("src_qa_pivot", f"SELECT * EXCLUDE (s_suppkey) FROM ({ANSWERED})")
def _(t):
    folder = new_folder(t.spark, "answers")
    answers(t).write.option("header", True).csv(folder)
    rows = files.read_named_csv(t.spark, folder, ["Filename", "Question", "Answer", "row_no"], ["Filename", "Question", "Answer"],
                                multi_line=True)
    return files.contracts_from_answers(rows.withColumn("row_no", F.col("row_no").cast("bigint"))).select(
        F.regexp_extract("file", r"^(.*)\.pdf$", 1).alias("contract_id"), "vendor", "type", "start_date", "end_date",
        "annual_value", "auto_renewal")


def flat_contracts(t: Tables) -> DataFrame:
    c = t.contracts()
    return c.select(
        F.when(F.col("s_suppkey") % 2 == 0, F.col("vendor")).alias("Vendor"),
        F.when(F.col("s_suppkey") % 2 == 1, F.col("vendor")).alias("Company"),
        F.date_format("start_date", "MMMM d, yyyy").alias("Start Date"), F.date_format("end_date", "yyyy-MM-dd").alias("End Date"),
        F.concat(F.lit("EUR "), american("annual_value")).alias("Amount"), F.col("s_suppkey").alias("row_no"))


@query("src_flat_contracts", """
SELECT vendor, 'SERVICE' AS type, start_date, coalesce(end_date, DATE '2026-12-31') AS end_date,
       annual_value::DOUBLE AS annual_value, false AS auto_renewal FROM contracts""")
def _(t):
    folder = new_folder(t.spark, "flat")
    rows = flat_contracts(t)
    rows.where("row_no % 3 = 0").write.option("header", True).csv(folder)
    rows.where("row_no % 3 <> 0").select(*reversed(rows.columns)).write.mode("append").option("header", True).csv(folder)
    table = files.read_named_csv(t.spark, folder, [*files.FLAT_NAMES, "row_no"], files.FLAT_NAMES)
    return files.contracts_from_flat(table).drop("row_no")


@query("union_renumber", """
, f AS (SELECT vendor, annual_value::DOUBLE AS annual_value, contract_id FROM contracts WHERE s_suppkey % 3 = 0),
g AS (SELECT vendor, annual_value::DOUBLE AS annual_value,
             printf('CTR-%03d', row_number() OVER (ORDER BY s_suppkey) + (SELECT count(*) FROM f)) AS contract_id
      FROM contracts WHERE s_suppkey % 3 <> 0)
SELECT * FROM f UNION ALL SELECT * FROM g""")
def _(t):
    """Contracts of one source kept, those of the other numbered after them."""
    c = t.contracts().select("vendor", F.col("annual_value").cast("double").alias("annual_value"), "contract_id", "s_suppkey")
    return numbering.union_renumbered(c.where("s_suppkey % 3 = 0").drop("s_suppkey"),
                                      c.where("s_suppkey % 3 <> 0").drop("contract_id"), "s_suppkey")


# ------------------------------------------------------------------------ tables


def typed_documents(t: Tables) -> DataFrame:
    inv = t.invoices(False, False, False).select(
        F.col("invoice_id").alias("id"), F.lit("invoice").alias("document_type"), "amount", F.lit("inv.json").alias("source_file"))
    ctr = t.contracts().select(
        F.col("contract_id").alias("id"), F.lit("contract").alias("document_type"), F.col("annual_value").alias("amount"),
        F.concat(F.col("type"), F.lit(".json")).alias("source_file"))
    return inv.unionByName(ctr).withColumn("amount", F.col("amount").cast("double"))


DOCUMENTS = """
, docs AS (SELECT invoice_id AS id, 'invoice' AS document_type, amount::DOUBLE AS amount, 'inv.json' AS source_file FROM invoices
           UNION ALL SELECT contract_id, 'contract', annual_value::DOUBLE, concat(type, '.json') FROM contracts)
"""


@query("sink_roundtrip", DOCUMENTS + """
SELECT document_type, count(*)::BIGINT AS n, sum(amount::DECIMAL(18,2))::DOUBLE AS total FROM docs GROUP BY document_type""")
def _(t):
    folder = new_folder(t.spark, "documents")
    sinks.save_documents(typed_documents(t), folder)
    back = sinks.load_documents(t.spark, folder, "id string, amount double, source_file string, document_type string")
    return edge(back.groupBy("document_type").agg(F.count("*").alias("n"), F.sum(money("amount")).alias("total")))


@query("ingest_stats", DOCUMENTS + """
SELECT document_type, count(*)::BIGINT AS documents, count(DISTINCT source_file)::BIGINT AS files FROM docs GROUP BY document_type
UNION ALL SELECT 'failed', count(*), count(DISTINCT conv_id % 7) FROM conversations WHERE role = 'user'""")
def _(t):
    failed = t.read("conversations").where("role = 'user'").select(
        (F.col("conv_id") % 7).cast("string").alias("source_file"), F.col("text").alias("error"))
    return sinks.ingest_stats(typed_documents(t), failed)


@query("sink_upsert", """
SELECT invoice_id, CASE WHEN o_orderkey % 5 = 0 THEN 'PAID' ELSE status END AS status,
       CASE WHEN o_orderkey % 5 = 0 THEN amount + 1 ELSE amount END::DOUBLE AS amount, year(date)::BIGINT AS year,
       CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 1 END::BIGINT AS version FROM invoices""")
def _(t):
    """A fifth of a stored table changed twice in one delivery, which comes again; what is shared is compacted."""
    base = t.invoices(False, False, False).select(
        "invoice_id", "status", "amount", F.year("date").cast("bigint").alias("year"), F.lit(1).cast("bigint").alias("version"), "o_orderkey")
    table = deltas.DeltaTable(t.spark, new_folder(t.spark, "table"), base.drop("o_orderkey").schema, ["invoice_id"], ["version"], buckets=8)
    table.upsert(base, "stored")
    fifth = base.where("o_orderkey % 5 = 0").drop("o_orderkey").withColumn("status", F.lit("PAID"))
    twice = fifth.withColumn("version", F.lit(2).cast("bigint")).unionByName(
        fifth.withColumn("version", F.lit(3).cast("bigint")).withColumn("amount", (F.col("amount") + 1).cast("decimal(18,2)")))
    table.upsert(twice, "changed")
    table.upsert(twice.withColumn("version", F.lit(9).cast("bigint")), "changed")
    table.compact()
    return edge(table.read())


@query("scenarios_upsert", """
, p AS (SELECT contract_id AS id, type AS name, (s_suppkey % 10)::DOUBLE / 10 AS probability,
               concat('["', type, '","', vendor, '"]') AS key_risks,
               CASE WHEN s_suppkey % 2 = 0 THEN 'review' ELSE 'draft' END AS source FROM contracts)
SELECT * FROM p""")
def _(t):
    """Scenario rows with their risk lists as JSON text, half of them replaced."""
    rows = t.contracts().select(
        F.col("contract_id").alias("id"), F.col("type").alias("name"), ((F.col("s_suppkey") % 10).cast("double") / 10).alias("probability"),
        F.to_json(F.array("type", "vendor")).alias("key_risks"), F.lit("draft").alias("source"), "s_suppkey")
    newer = rows.where("s_suppkey % 2 = 0").withColumn("source", F.lit("review"))
    return sinks.merge_latest(rows.drop("s_suppkey"), newer.drop("s_suppkey"), ["id"])


@query("sink_bad_records", """
SELECT CASE WHEN conv_id % 3 = 0 THEN 'bad' ELSE 'good' END AS kind, count(*)::BIGINT AS n FROM conversations GROUP BY 1""", finance=False)
def _(t):
    """Every third message cut off in the middle of its JSON."""
    folder = new_folder(t.spark, "messages")
    k = F.col("conv_id")
    text = F.to_json(F.struct(F.concat(F.lit("INV-"), k.cast("string")).alias("invoice_id"), F.col("role").alias("vendor")))
    t.read("conversations").select(F.when(k % 3 == 0, F.substring(text, 1, 14)).otherwise(text).alias("value")).write.text(folder)
    good, bad = sinks.split_bad(files.raw_invoices(t.spark, folder, whole_file=False))
    counts = good.select(F.lit("good").alias("kind"), F.col("invoice_id").alias("x")).unionByName(
        bad.select(F.lit("bad").alias("kind"), F.col("error").alias("x")))
    return counts.groupBy("kind").agg(F.count("*").alias("n"))


# ----------------------------------------------------------------------- streams

EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def event_stream(t: Tables) -> DataFrame:
    """The events table as a stream, its time with a zone so that it can carry a watermark."""
    schema = t.read("events").schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir).withColumn(
        "ts", F.col("ts").cast("timestamp"))


@query("stream_dedup", """
SELECT event_id, user_id, event_type, value, json_extract(props, '$.k')::BIGINT AS k FROM events""", finance=False)
def _(t):
    """Messages with JSON values, every fiftieth delivered twice."""
    stream = event_stream(t)
    sent = stream.unionByName(stream.where("event_id % 50 = 0"))
    opened = events.decode(sent.withColumn("value_text", F.col("value")).withColumn("value", F.col("props")), "k bigint")
    once = events.without_repeats(opened, ["event_id"], "ts")
    out = new_folder(t.spark, "dedup")
    events.run_to_files(once.select("event_id", "user_id", "event_type", F.col("value_text").alias("value"), F.col("data.k").alias("k")),
                        f"{out}/rows", f"{out}/state")
    return t.spark.read.schema("event_id bigint, user_id bigint, event_type string, value double, k bigint").parquet(f"{out}/rows")


LOG_LINE = r"^(\S+) (\w+) user=(\d+) type=(\w+) value=(-?[\d.]+)$"
LOG_COLUMNS = {"ts": "timestamp", "level": "string", "user_id": "bigint", "event_type": "string", "value": "double"}


@query("stream_logs", """
SELECT user_id, event_type, count(*)::BIGINT AS n FROM events GROUP BY user_id, event_type""", finance=False)
def _(t):
    """Log lines written from the events, read as a stream and taken apart."""
    folder = new_folder(t.spark, "logs")
    line = F.concat_ws(" ", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("INFO"),
                       F.concat(F.lit("user="), F.col("user_id").cast("string")), F.concat(F.lit("type="), "event_type"),
                       F.concat(F.lit("value="), F.round("value", 2).cast("decimal(18,2)").cast("string"), F.lit("  ")))
    t.read("events").select(line.alias("value")).write.text(f"{folder}/in")
    events.run_to_files(events.parse_logs(t.spark.readStream.text(f"{folder}/in"), LOG_LINE, LOG_COLUMNS), f"{folder}/out", f"{folder}/state")
    rows = t.spark.read.schema("line string, ts timestamp, level string, user_id bigint, event_type string, value double").parquet(f"{folder}/out")
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("stream_daily", """
SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*)::BIGINT AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events
GROUP BY 1, 2 HAVING date_trunc('day', any_value(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""", finance=False)
def _(t):
    """Totals of the days the watermark has closed."""
    out = new_folder(t.spark, "daily")
    events.run_to_files(events.daily_totals(event_stream(t), "ts", "event_type", "value"), f"{out}/rows", f"{out}/state")
    rows = t.spark.read.schema("day timestamp, event_type string, n bigint, total decimal(28,4)").parquet(f"{out}/rows")
    return edge(rows.withColumn("day", F.col("day").cast("date")))


@query("stream_upsert", """
SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id""", finance=False)
def _(t):
    """The last event of every user, kept up to date batch by batch."""
    folder = new_folder(t.spark, "nodes")
    events.run_upsert(event_stream(t).select("user_id", "event_id", "event_type"), f"{folder}/table", f"{folder}/state",
                      ["user_id"], ["event_id"], buckets=8)
    return deltas.DeltaTable(t.spark, f"{folder}/table", "user_id bigint, event_id bigint, event_type string", ["user_id"], ["event_id"]).read()


@query("stream_feedback", """
SELECT event_id AS prediction_id, value AS predicted_value, value * 2 AS actual_value FROM events WHERE event_id % 3 <> 0""", finance=False)
def _(t):
    """A prediction per event; its actual comes hours later, for every third too late."""
    stream = event_stream(t)
    predicted = stream.select(F.col("event_id").alias("prediction_id"), F.col("ts").alias("predicted_at"),
                              F.col("value").alias("predicted_value"))
    later = F.when(F.col("event_id") % 3 == 0, F.expr("ts + INTERVAL 30 HOURS")).otherwise(F.expr("ts + INTERVAL 5 HOURS"))
    actual = stream.select(F.col("event_id").alias("prediction_id"), later.alias("actual_at"), (F.col("value") * 2).alias("actual_value"))
    out = new_folder(t.spark, "feedback")
    events.run_to_files(events.actuals_meet_predictions(predicted, actual).select("prediction_id", "predicted_value", "actual_value"),
                        f"{out}/rows", f"{out}/state")
    return t.spark.read.schema("prediction_id bigint, predicted_value double, actual_value double").parquet(f"{out}/rows")


@query("stream_lapsed", """
WITH seen AS (SELECT least(max(ts), max(ts + INTERVAL 5 HOURS) FILTER (event_id % 3 <> 0)) - INTERVAL 1 HOUR AS mark FROM events)
SELECT event_id AS prediction_id, value AS predicted_value, CASE WHEN event_id % 3 <> 0 THEN value * 2 END AS actual_value
FROM events, seen WHERE event_id % 3 <> 0 OR ts + INTERVAL 1 DAY < mark""", finance=False)
def _(t):
    """A prediction per event, in four deliveries by time, the stream started anew for each; two of three are answered, half of those twice, the others lapse."""
    folder = new_folder(t.spark, "lapsed")
    rows = t.read("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    ends = rows.agg(F.min("ts").alias("low"), ((F.max("ts").cast("double") - F.min("ts").cast("double")) / 4).alias("step"))
    part = F.least(F.lit(3), F.floor((F.col("ts").cast("double") - F.col("low").cast("double")) / F.col("step")).cast("int"))
    t.spark.createDataFrame([], rows.schema).write.parquet(f"{folder}/in")  # the stream's folder has to be there
    dealt = written_once(attach(rows, ends).withColumn("part", part).select(*rows.columns, "part"), "deliveries")
    stream = t.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    predicted = stream.select(F.col("event_id").alias("prediction_id"), F.col("ts").alias("predicted_at"), F.col("value").alias("predicted_value"))
    answers = stream.where("event_id % 3 <> 0").select(
        F.col("event_id").alias("prediction_id"), F.expr("ts + INTERVAL 5 HOURS").alias("actual_at"), (F.col("value") * 2).alias("actual_value"))
    twice = answers.unionByName(answers.where("prediction_id % 2 = 0"))
    outcome = events.predictions_answered_or_lapsed(predicted, twice).select("prediction_id", "predicted_value", "actual_value")
    for i in range(4):
        dealt.where(F.col("part") == i).drop("part").write.mode("append").parquet(f"{folder}/in")
        events.run_to_files(outcome, f"{folder}/rows", f"{folder}/state")
    return t.spark.read.schema("prediction_id bigint, predicted_value double, actual_value double").parquet(f"{folder}/rows")


@query("stream_decisions", f"""
, di AS (SELECT *, least({DAYS}, 365) AS days, CASE WHEN {DAYS} >= 60 THEN 3 ELSE 2 END AS sev FROM invoices
         WHERE status = 'UNPAID' AND {DAYS} >= 30)
SELECT concat('overdue_invoice_', invoice_id) AS id,
       round(sev * greatest(0.1::DOUBLE, least(1.0::DOUBLE, amount::DOUBLE / 100000)) * (1 + least(days::DOUBLE / 100, 1.0::DOUBLE)) * 10, 1) AS priority_score
FROM di ORDER BY priority_score DESC, id LIMIT 5""")
def _(t):
    """Invoices arriving in files; after each batch the top decisions are worked out anew."""
    folder = new_folder(t.spark, "refresh")
    rows = billed(t).select("invoice_id", "due_date", "vendor", "amount", "status")
    rows.repartition(3, "invoice_id").write.parquet(f"{folder}/in")
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")

    def refresh(spark, batch_id):
        table = deltas.DeltaTable(spark, f"{folder}/table", rows.schema, ["invoice_id"], ["due_date"]).read()
        top = decisions.rank_decisions(decisions.invoice_decisions(table, AS_OF))
        top.write.mode("overwrite").parquet(f"{folder}/top")

    events.run_upsert(stream, f"{folder}/table", f"{folder}/state", ["invoice_id"], ["due_date"], refresh, buckets=8)
    return t.spark.read.schema("id string, priority_score double").parquet(f"{folder}/top")
