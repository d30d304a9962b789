"""Queries of names in texts, calls, chats, scanned files and case documents; the texts are made of the tables' keys, so SQL knows what they name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casefile.operators import entities, linking, mentions
from casefile.plans.registry import query
from casefile.session import table


def letters(number: Column | str) -> Column:
    return F.translate((F.col(number) if isinstance(number, str) else number).cast("string"), "0123456789", "abcdefghij")


def text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def named_sql(found: str, key: str) -> str:
    """``found``: key, name, prefix, category, role, confidence, mentions, risk_score, risk_level."""
    return f"""SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY mentions DESC, confidence DESC, name) AS INTEGER) AS place, name, prefix || trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
    category, role, CAST(confidence AS DOUBLE) AS confidence, CAST(mentions AS BIGINT) AS mentions, CAST(risk_score AS INTEGER) AS risk_score, risk_level, lower(name) = 'kumb rao' AS known FROM ({found})"""


SQL_LETTERS = "translate(CAST({} AS VARCHAR), '0123456789', 'abcdefghij')"
A, N, M = SQL_LETTERS.format("c_custkey"), SQL_LETTERS.format("c_nationkey"), SQL_LETTERS.format("c_custkey % 7")


def known(spark):
    return spark.createDataFrame([(" Kumb Rao ",)], "name string")


@query(
    named_sql(
        f"""SELECT c_custkey, 'ent_' AS prefix, unnest([
        {{'name': 'Kum' || {A} || ' Rao', 'category': 'PERSON', 'role': 'Identified Individual', 'confidence': 0.90, 'mentions': 4, 'risk_score': 70, 'risk_level': 'MEDIUM'}},
        {{'name': 'Des' || {A}, 'category': 'KINSHIP', 'role': 'Kinship / Associated Person', 'confidence': 0.92, 'mentions': 1, 'risk_score': 85, 'risk_level': 'HIGH'}},
        {{'name': 'Acme' || {A} || ' Traders', 'category': 'ORGANIZATION', 'role': 'Commercial Counterparty', 'confidence': 0.95, 'mentions': 1, 'risk_score': 70, 'risk_level': 'MEDIUM'}},
        {{'name': 'C. Ven' || {A} || ' K', 'category': 'PERSON', 'role': 'Patronymic Name', 'confidence': 0.88, 'mentions': 1, 'risk_score': 70, 'risk_level': 'MEDIUM'}},
        {{'name': 'Pal' || {A}, 'category': 'CONVERSATION', 'role': 'Directly Mentioned Party', 'confidence': 0.85, 'mentions': 1, 'risk_score': 85, 'risk_level': 'HIGH'}},
        {{'name': 'pay' || c_custkey || '@okaxis', 'category': 'DIGITAL_ID', 'role': 'Financial Identifier', 'confidence': 0.95, 'mentions': 1, 'risk_score': 85, 'risk_level': 'MEDIUM'}},
        {{'name': '9876' || right('000000' || c_custkey, 6), 'category': 'DIGITAL_ID', 'role': 'Contact Identifier', 'confidence': 0.90, 'mentions': 1, 'risk_score': 85, 'risk_level': 'MEDIUM'}},
        {{'name': 'Vel' || {A} || ' Iyer', 'category': 'PARTNER', 'role': 'Contract Signatory', 'confidence': 0.95, 'mentions': 2, 'risk_score': 70, 'risk_level': 'MEDIUM'}}], recursive := true) FROM customer""",
        "c_custkey",
    )
)
def names_in_statements(spark, d):
    a, k = letters("c_custkey"), F.col("c_custkey").cast("string")
    said = text(
        "Shri Kum", a, " Rao, aged 40 met S/O Des", a, " today.\nPlease call Kum", a, " Rao soon; Acme", a, "   Traders sent pay", k, "@okaxis and ", text("9876", F.lpad(k, 6, "0")), " to C. Ven", a, " K. report.pdf 1. Vel",
        a, " Iyer (Aadhar 7) They told Pal", a, " of the Main Road Meeting.",
    )
    rows = table(spark, d, "customer").select("c_custkey", said.alias("said"))
    return entities.names_of(rows, "c_custkey", "said", keywords=known(spark))


def talk_sql(people: str, prefix: str) -> str:
    said = f"SELECT c_nationkey, 'ent_' AS prefix, 'Kum' || {M} AS name, 'CONVERSATION' AS category, 'Directly Mentioned Party' AS role, 0.85 AS confidence, count(*) AS mentions, 85 AS risk_score, 'HIGH' AS risk_level FROM customer GROUP BY ALL"
    return f"{said} UNION ALL SELECT c_nationkey, '{prefix}', {people} GROUP BY ALL"


@query(named_sql(talk_sql(f"'Vik' || {N}, 'SPEAKER', 'Recorded Speaker', 0.95, 1, 75, 'HIGH' FROM customer WHERE c_custkey % 2 = 1", "ent_spk_"), "c_nationkey"))
def names_in_calls(spark, d):
    speaker = F.when(F.col("c_custkey") % 2 == 1, text("Agent (Mr. Vik", letters("c_nationkey"), ")")).otherwise("Speaker 1")
    rows = table(spark, d, "customer").select("c_nationkey", "c_custkey", speaker.alias("speaker"), text("Talk to Kum", letters(F.col("c_custkey") % 7), " about it").alias("said"))
    return mentions.names_in_calls(rows, "c_nationkey", "speaker", "said", "c_custkey", keywords=known(spark))


@query(named_sql(talk_sql("'Sen' || substr('abc', 1 + c_custkey % 3, 1) AS s, 'CHAT_PARTNER', 'Conversation Partner', 0.95, count(*), 80, 'HIGH' FROM customer WHERE c_custkey % 3 <> 1", "ent_chat_"), "c_nationkey"))
def names_in_chats(spark, d):
    sender = text("Sen", letters(F.col("c_custkey") % 3))
    rows = table(spark, d, "customer").select("c_nationkey", "c_custkey", sender.alias("sender"), text("cash paid to Kum", letters(F.col("c_custkey") % 7), " now").alias("said"))
    return mentions.names_in_chats(rows, "c_nationkey", "sender", "said", "c_custkey", custodian=F.lit(" senb "), keywords=known(spark))


@query(
    named_sql(
        f"""SELECT c_nationkey, 'ent_' AS prefix, 'Kum' || {M} || ' Traders' AS name, 'ORGANIZATION' AS category, 'Commercial Counterparty' AS role, 0.95 AS confidence, count(*) AS mentions, 70 AS risk_score, 'MEDIUM' AS risk_level FROM customer GROUP BY ALL
        UNION ALL SELECT c_nationkey, 'ent_', 'Des' || {M}, 'CONVERSATION', 'Directly Mentioned Party', 0.85, count(*), 85, 'HIGH' FROM customer GROUP BY ALL
        UNION ALL SELECT c_nationkey, 'ent_', 'Vik' || {M}, 'PERSON', 'Identified Individual', 0.90, count(*), 70, 'MEDIUM' FROM customer WHERE c_custkey % 2 = 0 GROUP BY ALL""",
        "c_nationkey",
    )
)
def names_in_hits(spark, d):
    x = letters(F.col("c_custkey") % 7)
    author = F.when(F.col("c_custkey") % 2 == 0, text("Mr. Vik", x)).otherwise("Scan")
    rows = table(spark, d, "customer").select("c_nationkey", "c_custkey", text("Kum", x, "_Traders-list.PDF").alias("file"), text("please ask Des", x, " today").alias("snippet"), author.alias("author"))
    return mentions.names_in_hits(rows, "c_nationkey", "file", "snippet", "author", "c_custkey", keywords=known(spark))


@query(
    named_sql(
        f"""SELECT c_nationkey, 'ent_ver_' AS prefix, 'Par' || {M} AS name, 'PARTNER' AS category, 'Signatory' AS role, 0.90 AS confidence, 2 * count(*) AS mentions, 85 AS risk_score, 'HIGH' AS risk_level FROM customer GROUP BY ALL
        UNION ALL SELECT c_nationkey, 'ent_ver_', 'Aut' || {M}, 'PERSON', 'Author', 0.88, count(*), 70, 'MEDIUM' FROM customer GROUP BY ALL
        UNION ALL SELECT c_nationkey, 'ent_ver_', 'Com' || {M}, 'COMPANY', 'Corporate Entity', 0.85, count(*), 70, 'MEDIUM' FROM customer GROUP BY ALL
        UNION ALL SELECT c_nationkey, 'ent_ver_', 'Fox' || {M} || ' Agency', 'ORGANIZATION', 'Commercial Counterparty', 0.95, count(*), 70, 'MEDIUM' FROM customer GROUP BY ALL""",
        "c_nationkey",
    )
)
def names_in_documents(spark, d):
    x = letters(F.col("c_custkey") % 7)
    found = F.array(F.struct(text("Par", x).alias("name"), F.lit("PARTNER").alias("category"), F.lit("Signatory").alias("role"), F.lit(2).alias("mentions"), F.lit(0.9).alias("confidence")))
    rows = table(spark, d, "customer").select("c_nationkey", "c_custkey", text("Fox", x, "_Agency 7.docx").alias("file"), found.alias("found"), text("Dr. Aut", x).alias("author"), text("Com", x).alias("company"))
    return mentions.names_in_documents(rows, "c_nationkey", "file", "found", "author", "company", "c_custkey", keywords=known(spark))


@query(
    """WITH n AS (SELECT c_custkey AS id, c_custkey // 6 AS g, c_custkey % 6 AS v, upper(md5(CAST(c_custkey // 6 AS VARCHAR))) AS h FROM customer),
    m AS (SELECT id, g, v, h, min(id) OVER (PARTITION BY g) AS first, min(v) OVER (PARTITION BY g) AS v0 FROM n)
    SELECT id AS c_custkey, CASE v WHEN 1 THEN 'Q' || substr(h, 9, 8) || ' V' || substr(h, 1, 8) WHEN 2 THEN 'V' || substr(h, 1, 8) || 'Q' || substr(h, 9, 8) WHEN 4 THEN 'ACME ' || substr(h, 17, 10) ELSE 'V' || substr(h, 1, 8) || ' Q' || substr(h, 9, 8) END AS key,
    first AS entity, CASE WHEN id = first THEN NULL WHEN v = 5 AND v0 = 0 THEN 'name' WHEN v = 4 THEN 'identifier' ELSE 'similar' END AS step FROM m"""
)
def entity_steps(spark, d):
    """Vendors under spellings of one name, or one identifier; an employee of the very same name."""
    k = F.col("c_custkey")
    v, h = k % 6, F.upper(F.md5(F.floor(k / 6).cast("string")))
    one, two = F.concat(F.lit("V"), h.substr(1, 8)), F.concat(F.lit("Q"), h.substr(9, 8))
    name = F.when(v == 1, text(two, " ", one)).when(v == 2, text(one, two)).when(v == 3, text(one, " ", two, " Pvt Ltd")).when(v == 4, text("Acme ", h.substr(17, 10))).otherwise(text(one, "  ", F.lower(two)))
    kind = F.when(v == 5, "EMPLOYEE").when(v == 1, "COMPANY").otherwise("VENDOR")
    number = F.when(v.isin(0, 4), F.concat(F.lit("ID "), F.floor(k / 6).cast("string")))
    rows = table(spark, d, "customer").select("c_custkey", name.alias("name"), kind.alias("kind"), number.alias("number"))
    return linking.resolve_entities(rows, "c_custkey", "name", "kind", "number").select("c_custkey", "key", "entity", "step")
