"""Queries of vendors against transactions and profiles, each with SQL that compares every pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from casefile.operators import crossref
from casefile.plans import views
from casefile.plans.registry import dec_sum, query
from casefile.session import table

OWNERS = ("urgent", "specified", "low", "medium", "igh", "nobody", "ok")
OWNER_SQL = "CASE s_suppkey " + " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(OWNERS)) + " ELSE 'owner ' || s_suppkey END"
VENDORS = f"""v AS (SELECT s_suppkey, 'A/C ' || right(lpad(CAST(s_suppkey AS VARCHAR), 12, '4'), 7) AS bank, 'NATION_' || s_suppkey AS code, ' Nation_' || s_suppkey AS name, {OWNER_SQL} AS owner,
    '+4 ' || lpad(CAST(s_suppkey AS VARCHAR), 4, '4') AS phone, 'x' || s_suppkey || '@mail.' || lower(s_name) AS email FROM supplier)"""
NUMBER = "regexp_replace({}, '[^0-9]', '', 'g')"


def vendors(spark, d):
    k = F.col("s_suppkey")
    key = k.cast("string")
    owner = F.coalesce(F.try_element_at(F.array(*map(F.lit, OWNERS)), (k + 1).cast("int")), F.concat(F.lit("owner "), key))
    return table(spark, d, "supplier").select(
        "s_suppkey", F.concat(F.lit("A/C "), F.substring(F.lpad(key, 12, "4"), 6, 7)).alias("bank"), F.concat(F.lit("NATION_"), key).alias("code"), F.concat(F.lit(" Nation_"), key).alias("name"),
        owner.alias("owner"), F.concat(F.lit("+4 "), F.lpad(key, 4, "4")).alias("phone"), F.concat(F.lit("x"), key, F.lit("@mail."), F.lower("s_name")).alias("email"),
    )


def either(sql: str) -> str:
    return f"({sql.format(t='lower(trim(party))')} OR {sql.format(t='lower(trim(narration))')})"


MET = f"""m AS (SELECT t.*, v.s_suppkey, v.bank, v.code, v.name, v.owner, v.phone,
    length({NUMBER.format('bank')}) >= 5 AND (contains({NUMBER.format('party')}, {NUMBER.format('bank')}) OR contains({NUMBER.format('narration')}, {NUMBER.format('bank')})) AS b,
    {either("(list_contains(regexp_split_to_array({t}, '\\s+'), lower(code)) OR list_contains(string_split({t}, '/'), lower(code)))")} AS c,
    {either("contains({t}, lower(trim(name)))")} AS n, length(owner) >= 3 AND {either("contains({t}, owner)")} AS o,
    length({NUMBER.format('phone')}) >= 5 AND (contains({NUMBER.format('party')}, {NUMBER.format('phone')}) OR contains({NUMBER.format('narration')}, {NUMBER.format('phone')})) AS f FROM txn t, v)"""
SHOWN = "concat_ws(', ', CASE WHEN b THEN 'Bank A/C: ' || bank END, CASE WHEN c THEN 'Code: ' || code END, CASE WHEN n THEN 'Name: ' || name END, CASE WHEN o THEN 'Owner: ' || owner END, CASE WHEN f THEN 'Phone: ' || phone END)"


@query(f", {VENDORS}, {MET} SELECT txn_id, s_suppkey, {SHOWN} AS attributes FROM m WHERE b OR c OR n OR o OR f", (views.TXN,))
def vendor_attributes(spark, d):
    return crossref.vendor_matches(views.txn(spark, d), "txn_id", "party", "narration", vendors(spark, d), "s_suppkey")


@query(
    f""", {VENDORS}, {MET}, k AS (SELECT party AS person, s_suppkey, CASE WHEN debit > 0 THEN 'OUT' ELSE 'IN' END AS direction, debit + credit AS amount, unnest(string_split({SHOWN}, ', ')) AS a, txn_id FROM m WHERE b OR c OR n OR o OR f),
    g AS (SELECT person, s_suppkey, direction, array_to_string(list_sort(list(DISTINCT a)), ', ') AS attributes FROM k GROUP BY 1, 2, 3),
    s AS (SELECT person, s_suppkey, direction, count(*) AS n, {dec_sum('amount')} AS volume FROM (SELECT DISTINCT person, s_suppkey, direction, txn_id, amount FROM k) GROUP BY 1, 2, 3) SELECT s.*, attributes FROM s JOIN g USING (person, s_suppkey, direction)""",
    (views.TXN,),
)
def vendor_person_flows(spark, d):
    way = F.when(F.col("debit") > 0, "OUT").otherwise("IN")
    out = crossref.vendor_flows(views.txn(spark, d), "txn_id", "party", "party", "narration", way, F.col("debit") + F.col("credit"), vendors(spark, d), "s_suppkey")
    return out.withColumn("volume", F.col("volume").cast("double"))


WORDS = "[' Supplier#0000000' || lpad(CAST(c_custkey % 90 AS VARCHAR), 2, '0'), 'nation_' || (c_custkey % 60), 'tel 44444' || (c_custkey % 40), 'X' || (c_custkey % 20) || '@', 'low', 'ab', 'specified person']"


@query(
    f"""WITH {VENDORS}, q AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'The Nation_' || (c_custkey % 11) WHEN 1 THEN 'urgent ' || c_custkey ELSE 'med' END AS own, unnest({WORDS}) AS k FROM customer),
    p AS (SELECT *, lower(trim(k)) AS w, {NUMBER.format('k')} AS kd, lower(trim(name)) AS vn, {NUMBER.format('phone')} AS pd, {NUMBER.format('bank')} AS bd FROM q, v),
    t AS (SELECT s_suppkey, c_custkey, unnest([CASE WHEN contains(vn, lower(own)) OR contains(lower(own), vn) THEN own END, CASE WHEN length(owner) >= 3 AND (contains(owner, lower(own)) OR contains(lower(own), owner)) THEN 'Owner: ' || owner END,
    CASE WHEN length(w) >= 3 AND (contains(vn, w) OR w = lower(code)) THEN w END, CASE WHEN length(w) >= 3 AND length(owner) >= 3 AND (contains(owner, w) OR contains(w, owner)) THEN 'Owner: ' || owner END, CASE WHEN length(w) >= 3 AND contains(email, w) THEN 'Email: ' || email END,
    CASE WHEN length(kd) >= 5 AND length(pd) >= 5 AND (contains(pd, kd) OR contains(kd, pd)) THEN 'Phone: ' || phone END, CASE WHEN length(kd) >= 5 AND (contains(bd, kd) OR contains(kd, bd)) THEN 'Bank A/C: ' || w END]) AS term FROM p)
    SELECT s_suppkey, c_custkey, array_to_string(list_sort(list(DISTINCT term)), ', ') AS terms FROM t WHERE term IS NOT NULL GROUP BY 1, 2"""
)
def vendor_profile_terms(spark, d):
    k = F.col("c_custkey")
    num = lambda n: (k % n).cast("string")
    own = F.when(k % 3 == 0, F.concat(F.lit("The Nation_"), num(11))).when(k % 3 == 1, F.concat(F.lit("urgent "), k.cast("string"))).otherwise("med")
    words = F.array(F.concat(F.lit(" Supplier#0000000"), F.lpad(num(90), 2, "0")), F.concat(F.lit("nation_"), num(60)), F.concat(F.lit("tel 44444"), num(40)), F.concat(F.lit("X"), num(20), F.lit("@")), F.lit("low"), F.lit("ab"), F.lit("specified person"))
    profiles = table(spark, d, "customer").select("c_custkey", own.alias("name"), words.alias("keywords"))
    return crossref.vendor_profiles(vendors(spark, d), "s_suppkey", profiles, "c_custkey")
