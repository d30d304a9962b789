"""Who a transaction or text is about: counterparties from narrations, their kind, known names in texts, tags."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casefile.functions.text import word_hit

# Words that decide results.
BALANCE_MARKERS = ("OPENING BALANCE", "CLOSING BALANCE", "OPBAL", "BALANCE B/F", "BAL B/F", "BROUGHT FORWARD")
BANKING_WORDS = (
    "UPI", "UPIIN", "UPIOUT", "P2A", "P2M", "PAY", "IN", "OUT", "INR", "DR", "CR", "NEFT", "RTGS", "IMPS", "POS", "ATM", "TXN", "TRF", "TRANSFER", "NFS", "MAT",
    "CASH", "CHG", "CHGS", "REV", "REVERSAL", "DEBIT", "CREDIT", "REMITTANCE", "SETTLEMENT", "OWN", "WDL", "DEP", "PURCHASE", "SELF", "SWITCH", "AT", "CASHNT", "IW", "NACH",
)
KINDS = (
    ("COMPANY", ("industrial", "industries", "manufacturing", "mfg", "motors", "corporation", "company")),
    ("VENDOR", ("ltd", "limited", "corp", "inc", "llp", "enterprises", "solutions", "pvt", "private", "traders", "engineers", "vendor", "agency", "supplier", "logistics", "supermarket", "electricity", "petrol", "pharmacy", "appliances", "seller", "school", "store", "mart")),
    ("BANK_ACCOUNT", ("bank", "idfc", "hdfc", "icici", "sbi", "axis", "kotak", "canara", "account", "a/c", "okaxis", "oksbi", "okicici", "upi")),
)
NOBODY = ("out", "in", "tfr", "conduit", "unknown", "unknown counterparty")


def is_balance_marker(*texts: Column) -> Column:
    """Lines that carry a balance and are no transaction."""
    upper = [F.upper(F.coalesce(t, F.lit(""))) for t in texts]
    return reduce(lambda a, m: a | reduce(lambda b, t: b | t.contains(m), upper, F.lit(False)), BALANCE_MARKERS, F.lit(False))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \-_/]+|[ \-_/]+$", "")


def counterparty(party: Column, narration: Column) -> Column:
    """The payer of a salary line, else the party without signs about it, else Unknown Counterparty."""
    n, p = F.trim(F.coalesce(narration, F.lit(""))), trimmed(F.coalesce(party, F.lit("")))
    second = F.try_element_at(F.filter(F.transform(F.split(n, "/"), lambda x: trimmed(x)), lambda x: x != ""), F.lit(2))
    salary = F.upper(n).startswith("SAL/") & (F.length(second) > 2) & ~second.rlike(r"^\d+$")
    named_so = (F.upper(p) == "SAL") & n.contains("/") & (F.length(second) > 2)
    return F.when(salary | named_so, second).when(p != "", p).otherwise("Unknown Counterparty")


def kind_of_party(party: Column, narration: Column) -> Column:
    """EMAIL_ID, COMPANY, VENDOR, BANK_ACCOUNT, UNKNOWN or EMPLOYEE, by the first list with a word in the name."""
    low = F.lower(F.trim(party))
    salary = F.lower(F.coalesce(narration, F.lit(""))).startswith("sal/")
    out = F.when(low.contains("@"), "EMAIL_ID")
    for kind, words in KINDS:
        hit = reduce(lambda a, w: a | low.contains(w), words, F.lit(False))
        out = out.when(hit | salary if kind == "COMPANY" else hit, kind)
    return out.when(low.isin(*NOBODY), "UNKNOWN").otherwise("EMPLOYEE")


def letters_only(c: Column) -> Column:
    """Upper-case text before an @, without digits and handles, dots and commas as blanks."""
    out = F.regexp_replace(F.substring_index(F.upper(c), "@", 1), r"[-–—]?\d+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[.,]", " "), r"\s+", " "))


def tracking_name(narration: Column) -> Column:
    """A name from a narration: user of a payment address, first speaking part between slashes, merchant, first words."""
    n = F.upper(F.trim(F.regexp_replace(F.coalesce(narration, F.lit("")), r"\s+", " ")))
    parts = F.filter(F.transform(F.split(n, "/"), lambda t: F.trim(t)), lambda t: t != "")
    speaks = lambda t: (F.length(t) > 2) & ~t.isin(*BANKING_WORDS)
    user = letters_only(F.try_element_at(F.filter(parts, lambda t: t.contains("@")), F.lit(1)))
    between = F.try_element_at(F.filter(F.transform(F.filter(parts, lambda t: ~t.rlike(r"^[A-Z]{4}0[A-Z0-9]{6}$")), letters_only), speaks), F.lit(1))
    words = lambda text: F.filter(F.split(F.trim(F.regexp_replace(text, r"\b[A-Z0-9]*\d[A-Z0-9]*\b|[/|\-_:+=@.]", " ")), r"\s+"), lambda w: w.rlike("^[A-Z]{2,}$") & ~w.isin(*BANKING_WORDS))
    merchant = F.array_join(words(F.regexp_replace(n, "POS|PURCHASE", " ")), " ")
    plain = F.array_join(F.slice(words(n), 1, 3), " ")
    name = F.when(n == "", "Internal Transfer").when(n.contains("@") & speaks(user), user).when(n.contains("/"), between)
    shop = F.when((n.contains("POS") | n.startswith("PURCHASE")) & (merchant != ""), merchant)
    return F.coalesce(name, shop, F.nullif(plain, F.lit("")), F.lit("Other Account Operations"))


def worth_linking(rows: DataFrame, keywords: Sequence[str], amount: str, risk: str, party: str, narration: str, least: float = 50_000.0) -> DataFrame:
    """Transactions for the graph: a keyword of three letters or more in them, risk from 50, or an amount from ``least``."""
    words = [k.lower() for k in keywords if len(k.strip()) >= 3]
    named = reduce(lambda a, k: a | F.lower(F.coalesce(party, F.lit(""))).contains(k) | F.lower(F.coalesce(narration, F.lit(""))).contains(k), words, F.lit(False))
    keep = named | (F.coalesce(F.col(risk), F.lit(0)) >= 50) | (F.col(amount) >= least)
    return rows.filter(keep & ~is_balance_marker(F.col(party), F.col(narration)))


def tags(rows: DataFrame, keep: Sequence[str], text: str, classes: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """keep, term, type: every term of a text once, with the first class that lists it."""
    seen, terms = set(), []
    for kind, words in classes:
        for w in words:
            if w.lower() not in seen:
                seen.add(w.lower())
                terms.append((w.lower(), kind))
    hits = F.array_compact(F.array(*[F.when(word_hit(F.col(text), w), F.struct(F.lit(w.upper()).alias("term"), F.lit(k).alias("type"))) for w, k in terms]))
    return rows.select(*keep, F.explode(hits).alias("t")).select(*keep, "t.term", "t.type")


def find_entity(entities: DataFrame, asked: str, name: str = "name", identifier: str = "identifier", alias: str = "alias") -> DataFrame:
    """At most one entity: equal name, then identifier, then alias, else (three letters on) a name or alias with it in."""
    q, low = asked.strip().lower(), lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    long = F.lit(len(q) >= 3)
    rank = F.when(low(name) == q, 0).when(low(identifier) == q, 1).when(low(alias) == q, 2).when(long & low(name).contains(q), 3).when(long & low(alias).contains(q), 4)
    return entities.withColumn("match_rank", rank).filter(F.col("match_rank").isNotNull() & F.lit(bool(q))).orderBy("match_rank", name, identifier).limit(1)


def names_in_texts(texts: DataFrame, id_col: str, text: str, entities: DataFrame, name: str) -> DataFrame:
    """id, name of known one-word names in texts, by joining tokens; longest first within a text as place."""
    known = entities.select(F.col(name).alias("entity"), F.lower(F.trim(name)).alias("token")).filter(F.length("token") >= 3).distinct()
    tokens = texts.select(id_col, F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"))).alias("token"))
    found = tokens.join(known, "token").select(id_col, "entity").distinct()
    return found.withColumn("place", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(F.length("entity")), "entity")))


def relation_kind(edge_type: Column, label: Column) -> Column:
    """How an edge is drawn: vendor flow, kinship, role, layering, communication or other."""
    both = F.concat_ws(" ", F.lower(edge_type), F.lower(label))
    return (
        F.when(both.rlike("kickback|payout|vendor"), "vendor_flow").when(both.rlike("spouse|wife|husband|son|daughter|kin|relative"), "kinship").when(both.rlike("designation|role|director|manager"), "role")
        .when(both.rlike("layering|conduit|round"), "layering").when(both.rlike("mail|chat|call|intercept|message"), "communication").otherwise("other")
    )


def enrich(rows: DataFrame, masters: Sequence[tuple[DataFrame, str, str, str]], default: str = "Not Applicable") -> DataFrame:
    """Rows with a label from each master (table, key in rows, key in master, label); missing keys match missing keys.

    A key that a master does not hold gives the default. Masters hold one row per key.
    """
    for i, (master, key, own, label) in enumerate(masters):
        side = master.select(F.col(own).alias(f"_m{i}"), F.col(label).alias(f"_l{i}"))
        joined = rows.join(side, F.col(key).eqNullSafe(F.col(f"_m{i}")), "left")
        rows = joined.withColumn(f"{key}_label", F.concat_ws(" - ", F.coalesce(F.col(key).cast("string"), F.lit("none")), F.coalesce(f"_l{i}", F.lit(default)))).drop(f"_m{i}", f"_l{i}")
    return rows
