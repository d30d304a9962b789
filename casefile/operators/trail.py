"""Fund flows: matches between statements, conduits, round trips, layering, pass-through patterns, scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casefile import params
from casefile.functions.text import cents, half_up
from casefile.operators.cases import name_tokens
from casefile.operators.procurement import total

DAY = 86_400


def seconds(c: str):
    return F.unix_timestamp(F.col(c).cast("timestamp"))


def match_reference(debits: DataFrame, credits: DataFrame, reference: str, person: str, amount: str, keep: Sequence[str]) -> DataFrame:
    """Debits and credits of different persons with the same bank reference; the debit's amount counts."""
    d = debits.filter(F.col(reference).isNotNull()).select(F.col(reference), F.col(person).alias("sender"), F.col(amount).alias("amount"), *(F.col(c).alias(f"sender_{c}") for c in keep))
    c = credits.filter(F.col(reference).isNotNull()).select(F.col(reference), F.col(person).alias("recipient"), *(F.col(x).alias(f"recipient_{x}") for x in keep))
    return d.join(c, reference).filter(F.col("sender") != F.col("recipient"))


def mentions(said: Column, person: Column, address: Column | None) -> Column:
    """Whether a text names a person: the whole name, a token of it (three letters on, no title) or the payment address."""
    low, name = F.lower(said), F.lower(F.trim(person))
    found = (name != "") & (F.contains(low, name) | F.exists(name_tokens(person), lambda t: F.contains(low, t)))
    if address is None:
        return found
    own = F.lower(F.trim(F.coalesce(address, F.lit(""))))
    return found | ((own != "") & F.contains(low, own))


def match_fallback(
    debits: DataFrame, credits: DataFrame, person: str, date: str, amount: str, said: str, row: str, address: str | None = None, matched: DataFrame | None = None
) -> DataFrame:
    """Legs on the same date for the same amount where one side's text names the other: sender, recipient, debit_row, credit_row, amount.

    said: all texts of a leg; matched: (debit_row, credit_row) of matches by reference, whose legs are left out. An equi
    join with a residual test.
    """
    if matched is not None:
        debits = debits.join(matched.select(F.col("debit_row").alias(row)), row, "left_anti")
        credits = credits.join(matched.select(F.col("credit_row").alias(row)), row, "left_anti")
    none = F.lit(None).cast("string")
    side = lambda df, who, p: df.select(
        F.col(person).alias(who), F.col(date).alias("day"), F.col(amount).alias("amount"), F.col(said).alias(f"{p}_said"), (F.col(address) if address else none).alias(f"{p}_address"), F.col(row).alias(f"{p}_row")
    )
    both = side(debits, "sender", "debit").join(side(credits, "recipient", "credit"), ["day", "amount"]).filter(F.col("sender") != F.col("recipient"))
    named = mentions(F.col("debit_said"), F.col("recipient"), F.col("credit_address")) | mentions(F.col("credit_said"), F.col("sender"), F.col("debit_address"))
    return both.filter(named).select("sender", "recipient", "debit_row", "credit_row", "amount")


def in_window(first: DataFrame, then: DataFrame, keys: Sequence[str], t_first: str, t_then: str, days: int) -> DataFrame:
    """Pairs with equal keys where ``t_then`` (seconds) is at ``t_first`` or up to ``days`` later; 0 days: whenever later.

    Times fall into buckets as long as the window, and the first side stands in its own and the next, so a pair meets
    once and a key is split along its time however many rows it has.
    """
    after = F.col(t_then) >= F.col(t_first)
    if not days:
        return first.join(then, list(keys)).filter(after)
    place = lambda t: F.floor(F.col(t) / (days * DAY))
    first = first.withColumn("_bucket", F.explode(F.array(place(t_first), place(t_first) + 1)))
    then = then.withColumn("_bucket", place(t_then))
    return first.join(then, [*keys, "_bucket"]).filter(after & (F.col(t_then) - F.col(t_first) <= days * DAY)).drop("_bucket")


def conduits(inflows: DataFrame, outflows: DataFrame, key: str, ts: str, amount: str, row: str, days: int = 3, least: float = 0.0) -> DataFrame:
    """What comes in and goes on within ``days`` (0: whenever later) in no larger an amount: retention, its share, tier."""
    i = inflows.filter(F.col(amount) >= least).select(F.col(key), F.col(row).alias("in_row"), seconds(ts).alias("t_in"), F.col(amount).alias("in_amount"))
    o = outflows.filter(F.col(amount) >= least).select(F.col(key), F.col(row).alias("out_row"), seconds(ts).alias("t_out"), F.col(amount).alias("out_amount"))
    hop = in_window(i, o, [key], "t_in", "t_out", days).filter(F.col("out_amount") <= F.col("in_amount"))
    kept = cents(F.col("in_amount")) - cents(F.col("out_amount"))
    share = F.when(F.col("in_amount") > 0, half_up(kept * 100, cents(F.col("in_amount")), 2)).otherwise(0.0)
    gap = F.col("t_out") - F.col("t_in")
    tier = F.when(gap <= DAY, "RAPID_LAYERING").otherwise("DELAYED")
    return hop.select(key, "in_row", "out_row", "in_amount", "out_amount", (kept / 100).alias("retained"), share.alias("retained_pct"), gap.alias("gap_seconds"), tier.alias("tier"))


def conduit_groups(hops: DataFrame, key: str) -> DataFrame:
    """Per conduit: hops, volume, retained total, fastest hop and scores."""
    out = hops.groupBy(key).agg(F.count(F.lit(1)).alias("hops"), total("out_amount").alias("volume"), total("retained").alias("retained"), F.min("gap_seconds").alias("fastest"))
    value = F.when(F.col("retained") > 0, F.least(F.lit(100), F.call_function("div", cents(F.col("retained")), F.lit(50_000).cast("long")))).otherwise(5)
    slow = F.greatest(F.lit(20), 100 - F.call_function("div", F.col("fastest") + 8639, F.lit(8640).cast("long")))
    velocity = F.when(F.col("fastest") <= DAY // 2, 98).when(F.col("fastest") <= DAY, 90).when(F.col("fastest") <= 2 * DAY, 75).when(F.col("fastest") <= 3 * DAY, 60).otherwise(slow)
    out = out.withColumn("value_score", value.cast("int")).withColumn("velocity_score", velocity.cast("int"))
    composite = F.floor((F.col("value_score") * 4 + F.col("velocity_score") * 3 + 300) / 10)
    return out.withColumn("composite", F.least(F.lit(99), F.greatest(F.lit(10), composite)).cast("int"))


def round_trips(edges: DataFrame, src: str, dst: str, amount: str) -> DataFrame:
    """Pairs with money both ways, once in each direction."""
    a = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"), F.col(amount).alias("there"))
    b = edges.select(F.col(dst).alias("a"), F.col(src).alias("b"), F.col(amount).alias("back"))
    return a.join(b, ["a", "b"]).filter(F.col("a") != F.col("b"))


def party_key(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))


def hours(gap: Column) -> Column:
    """Seconds as hours with one digit, a tenth at least."""
    return F.greatest(F.lit(0.1), half_up(gap, F.lit(3600), 1))


def kickbacks(outflows: DataFrame, inflows: DataFrame, key: str, ts: str, amount: str, row: str, party: str, days: int = 3, least: float = params.MIN_TRANSACTION, holder: str | None = None) -> DataFrame:
    """Money that comes back to an account within ``days`` (0: whenever later) from the party that it went to, or one alike.

    Parties are alike if they are equal or one of four letters or more is contained in the other; unknown parties and the
    holder are none. All pairs count; of those that agree in account, both times and the outflow's amount the first by
    rows stays. Returns key, out_row, in_row, out_amount, in_amount, retained, retained_pct, gap_hours.
    """
    name = lambda df, p: df.filter(F.col(amount) >= least).select(
        key, F.col(row).alias(f"{p}_row"), seconds(ts).alias(f"t_{p}"), F.col(amount).alias(f"{p}_amount"), party_key(party).alias(f"{p}_party"), (party_key(holder) if holder else F.lit("")).alias(f"{p}_holder")
    )
    known = lambda p: (F.col(f"{p}_party") != "") & (F.col(f"{p}_party") != F.col(f"{p}_holder"))
    o, i = name(outflows, "out").filter(known("out")).drop("out_holder"), name(inflows, "in").filter(known("in")).drop("in_holder")
    within = lambda a, b: (F.length(a) >= 4) & F.contains(F.col(b), F.col(a))
    alike = (F.col("in_party") == F.col("out_party")) | within("in_party", "out_party") | within("out_party", "in_party")
    both = in_window(o, i, [key], "t_out", "t_in", days).filter(alike)
    first = Window.partitionBy(key, "t_out", "t_in", "out_amount").orderBy("out_row", "in_row")
    both = both.withColumn("_place", F.row_number().over(first)).filter("_place = 1")
    kept = F.greatest(F.lit(0).cast("long"), cents(F.col("out_amount")) - cents(F.col("in_amount")))
    share = F.when(F.col("out_amount") > 0, half_up(kept * 100, cents(F.col("out_amount")), 1)).otherwise(0.0)
    return both.select(key, "out_row", "in_row", "out_amount", "in_amount", (kept / 100).alias("retained"), share.alias("retained_pct"), hours(F.col("t_in") - F.col("t_out")).alias("gap_hours"))


def pair_matrix(profiles: DataFrame, edges: DataFrame, name: str, src: str, dst: str, count: str, amount: str, most: int = 2_000) -> DataFrame:
    """Every ordered pair of profiles with its transfers and volume, empty cells as 0.

    The grid of all pairs is the result, so there may be at most ``most`` profiles; with more this raises, and
    ``edges`` summed by their ends (the cells that are not empty) is the table to use.
    """
    names = profiles.select(F.col(name)).distinct()
    if names.limit(most + 1).count() > most:
        raise ValueError(f"a matrix of more than {most} profiles")
    a, b = names.select(F.col(name).alias("sender")), names.select(F.col(name).alias("recipient"))
    grid = a.crossJoin(F.broadcast(b))  # at most ``most`` rows each
    sums = edges.groupBy(F.col(src).alias("sender"), F.col(dst).alias("recipient")).agg(F.sum(count).alias("transfers"), total(amount).alias("volume"))
    return grid.join(sums, ["sender", "recipient"], "left").fillna({"transfers": 0, "volume": 0.0})


def beats(rows: DataFrame, case: str, order: Sequence[str], amount: str) -> DataFrame:
    """Numbered legs of a case with the running total."""
    w = Window.partitionBy(case).orderBy(*order)
    running = F.sum(F.col(amount).cast("decimal(18,2)")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double")
    return rows.withColumn("leg", F.concat(F.lit("L"), F.row_number().over(w).cast("string"))).withColumn("running", running)


def case_story(direct: DataFrame, hops: DataFrame, loops: DataFrame) -> DataFrame:
    """The legs of cases as beats in order of date (those without one last): case, n, edge_id, kind, title, date, from_node, to_node, via, amount, retained, cumulative.

    direct: case, row, sender, recipient, amount, date; hops: case, row, sender, conduit, recipient, out_date, in_date, outflow,
    inflow, retained; loops: case, row, originator, counterparty, amount, date; row is an id that orders a table. What one sender dispatches to
    a conduit on a date is one beat, followed by what the conduit passes on. A return that a beat tells of (same ends without regard to
    case, amounts less than one apart; the first such beat) makes it the return, else it is a beat of its own. A case ends with a
    summary. Only beats of one case meet in a group.
    """
    clean = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    place = lambda part, first, leg: F.struct(F.lit(part).alias("part"), first.alias("first"), leg.alias("leg"))
    long, zero = lambda c: F.col(c).cast("long"), F.lit(0).cast("long")

    def beat(df: DataFrame, at: Column, kind: str, a: Column, b: Column, via: Column, amount: Column, kept: Column, date: Column, title: Column | None = None) -> DataFrame:
        named = title if title is not None else F.concat(a, F.lit(" → "), b)
        return df.select("case", at.alias("at"), F.lit(kind).alias("kind"), named.alias("title"), date.alias("date"), a.alias("from_node"), b.alias("to_node"), via.alias("via"), amount.alias("amount"), kept.alias("retained"))

    none, nothing = F.lit(""), F.lit(0.0)
    parts = [beat(direct, place(0, long("row"), zero), "direct", clean("sender"), clean("recipient"), none, F.col("amount"), nothing, clean("date"))]
    dispatch = Window.partitionBy("case", "_sender", "_conduit", "_date")
    hops = hops.withColumns({"_sender": clean("sender"), "_conduit": clean("conduit"), "_date": clean("out_date")}).withColumn("_first", F.min(long("row")).over(dispatch))
    sent = hops.groupBy("case", "_sender", "_conduit", "_date").agg(total("outflow").alias("amount"), F.min("_first").alias("_first"))
    parts.append(beat(sent, place(1, F.col("_first"), F.lit(-1).cast("long")), "hop", F.col("_sender"), F.col("_conduit"), F.col("_conduit"), F.col("amount"), nothing, F.col("_date")))
    parts.append(beat(hops, place(1, F.col("_first"), long("row")), "hop", F.col("_conduit"), clean("recipient"), F.col("_conduit"), F.col("inflow"), F.col("retained"), clean("in_date")))
    told = reduce(DataFrame.unionByName, parts)
    back = loops.filter((F.col("amount") > 0) & ~clean("date").isin("", "-"))
    back = back.select("case", F.col("row").alias("l_row"), clean("originator").alias("to"), clean("counterparty").alias("of"), F.col("amount").alias("l_amount"), clean("date").alias("l_date"))
    known = told.select(F.col("case").alias("k_case"), F.col("at").alias("k_at"), F.col("from_node").alias("k_from"), F.col("to_node").alias("k_to"), F.col("amount").alias("k_amount"))
    same = (F.col("case") == F.col("k_case")) & (F.lower("of") == F.lower("k_from")) & (F.lower("to") == F.lower("k_to")) & (F.abs(F.col("k_amount") - F.col("l_amount")) < 1)
    met = back.join(known, same, "left").groupBy("case", "l_row", "to", "of", "l_amount", "l_date").agg(F.min("k_at").alias("k_at"))
    title = F.concat(F.lit("Loop Return: "), F.col("of"), F.lit(" → "), F.col("to"))
    # Of several returns that one beat tells of the last gives its title.
    closes = met.filter("k_at is not null").groupBy(F.col("case").alias("c_case"), F.col("k_at").alias("c_at")).agg(F.max_by(title, "l_row").alias("c_title"))
    told = told.join(closes, (F.col("case") == F.col("c_case")) & (F.col("at") == F.col("c_at")), "left")
    closing = F.col("c_title").isNotNull()
    told = told.withColumns({"kind": F.when(closing, "return").otherwise(F.col("kind")), "title": F.coalesce("c_title", "title")}).drop("c_case", "c_at", "c_title")
    own = met.filter("k_at is null")
    told = told.unionByName(beat(own, place(2, long("l_row"), zero), "return", F.col("of"), F.col("to"), F.col("of"), F.col("l_amount"), nothing, F.col("l_date"), title))
    order = Window.partitionBy("case").orderBy(F.when(F.col("date") == "", "9999-99-99").otherwise(F.col("date")), "at")
    running = F.sum(F.col("retained").cast("decimal(18,2)")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("double")
    told = told.withColumn("n", F.row_number().over(order)).withColumn("cumulative", running).withColumn("edge_id", F.concat(F.lit("L"), F.col("n").cast("string")))
    columns = ["case", "n", "edge_id", "kind", "title", "date", "from_node", "to_node", "via", "amount", "retained", "cumulative"]
    last = told.groupBy("case").agg(F.max("n").alias("n"), total("retained").alias("cumulative"))
    last = last.select(
        "case", (F.col("n") + 1).alias("n"), none.alias("edge_id"), F.lit("summary").alias("kind"), F.lit("Case Position: Full Topology Reconciled").alias("title"), F.lit("All Dates").alias("date"),
        none.alias("from_node"), none.alias("to_node"), none.alias("via"), nothing.alias("amount"), nothing.alias("retained"), "cumulative",
    )
    return told.select(columns).unionByName(last.select(columns))


class Open:
    """Inflows of one account that still have money to pass on, in row order."""

    def __init__(self) -> None:
        self.rows: list[list] = []  # in_row, time, cents left, party

    def take(self, out_row: int, t: int, cents_out: int, party: str, reach: int | None) -> list[tuple[int, int, int]]:
        """(in_row, out_row, cents) of what an outflow takes from the open inflows of other parties, the first of them first."""
        if reach is not None:
            self.rows = [r for r in self.rows if t - r[1] <= reach]
        legs = []
        for r in self.rows:
            if cents_out <= 0:
                break
            if r[3] != party:
                part = min(r[2], cents_out)
                r[2] -= part
                cents_out -= part
                legs.append((r[0], out_row, part))
        if legs:
            self.rows = [r for r in self.rows if r[2] > 0]
        return legs


def rapid_layering(
    rows: DataFrame, account: str, ts: str, amount: str, leg: str, party: str, row: str, days: int = 3, least: float = params.MIN_TRANSACTION, holder: str | None = None
) -> DataFrame:
    """Ordered allocation of inflows to later outflows, per account; ``days`` 0: to any later one.

    Rows are ordered by time and ``row``, an id. An inflow may go on in later rows within ``days`` to parties other than its
    own and the holder; blank parties take no part. Earlier inflows come first, and each fills earlier outflows first. Returns account, in_row,
    out_row, sender, recipient, forwarded, dispatched (the inflow's amount by its legs' shares,
    the rest with the last), retained (of the leg), retained_pct (of the inflow), gap_hours.

    What an inflow has left depends on all rows before, so an account is worked through in order, but in a stream: a task
    holds the inflows that are still open and no more. Where all of an account's inflows are out of reach it is cut, and
    its pieces are worked through apart.
    """
    w = Window.partitionBy("account").orderBy("t", "id")
    slim = rows.filter((F.col(amount) >= least) & F.col(leg).isin("IN", "OUT")).select(
        F.col(account).alias("account"), seconds(ts).alias("t"), cents(F.col(amount)).alias("cents"), (F.col(leg) == "IN").alias("into"), party_key(party).alias("party"),
        (party_key(holder) if holder else F.lit("")).alias("holder"), F.col(row).alias("id"),
    )
    slim = slim.filter((F.col("party") != "") & (F.col("into") | (F.col("party") != F.col("holder"))))
    slim = slim.withColumn("row", F.row_number().over(w).cast("long"))
    last_in = F.max(F.when(F.col("into"), F.col("t"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.coalesce(F.col("t") - last_in > days * DAY, F.lit(True)) if days else F.row_number().over(w) == 1
    slim = slim.withColumn("piece", F.sum(cut.cast("long")).over(w)).select("account", "piece", "row", "id", "t", "cents", "into", "party")
    ordered = slim.drop("id").repartition("account", "piece").sortWithinPartitions("account", "piece", "row")
    kind = slim.schema["account"].dataType.simpleString()
    reach = days * DAY if days else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, opened = None, Open()
        for batch in batches:
            out: list[tuple] = []
            for who, piece, row, t, value, into, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (who, piece) != key:
                    key, opened = (who, piece), Open()
                if into:
                    opened.rows.append([row, t, value, name])
                else:
                    out.extend((who, *leg) for leg in opened.take(row, t, value, name, reach))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["account", "in_row", "out_row", "part"])

    legs = ordered.mapInArrow(work, f"account {kind}, in_row long, out_row long, part long")
    about = lambda p: slim.select(F.col("account").alias(f"{p}_account"), F.col("row").alias(f"{p}_no"), F.col("id").alias(f"{p}_id"), F.col("t").alias(f"{p}_t"), F.col("cents").alias(f"{p}_cents"), F.col("party").alias(f"{p}_party"))
    for p in ("in", "out"):
        legs = legs.join(about(p), (F.col("account") == F.col(f"{p}_account")) & (F.col(f"{p}_row") == F.col(f"{p}_no"))).drop(f"{p}_account", f"{p}_no")
    inflow = Window.partitionBy("account", "in_row")
    forwarded = F.sum("part").over(inflow)
    legs = legs.withColumn("forwarded_all", forwarded).withColumn("share", F.expr("(2 * cast(in_cents as decimal(20,0)) * part + forwarded_all) div (2 * forwarded_all)"))
    before = inflow.orderBy("out_row").rowsBetween(Window.unboundedPreceding, -1)
    last = F.lead("out_row").over(inflow.orderBy("out_row")).isNull()
    legs = legs.withColumn("given", F.when(last, F.col("in_cents") - F.coalesce(F.sum("share").over(before), F.lit(0))).otherwise(F.col("share")))
    gap = F.col("out_t") - F.col("in_t")
    return legs.select(
        "account", F.col("in_id").alias("in_row"), F.col("out_id").alias("out_row"), F.col("in_party").alias("sender"), F.col("out_party").alias("recipient"), (F.col("part") / 100).alias("forwarded"), (F.col("given") / 100).alias("dispatched"),
        (F.greatest(F.lit(0).cast("long"), F.col("given") - F.col("part")) / 100).alias("retained"),
        half_up((F.col("in_cents") - F.col("forwarded_all")) * 100, F.col("in_cents"), 2).alias("retained_pct"), F.when(gap == 0, 0.5).otherwise(hours(gap)).alias("gap_hours"),
    )


def consume(days_of: list[tuple[int, int, int, int, int]], span: int, low: float) -> list[tuple[int, int, int, int, int, int]]:
    """(day, last day, cents in, cents out, inflows, outflows) of each day with inflows, from (day, cents in, inflows, cents out, outflows).

    The outflows of the days from an inflow's on are used up if they are at least ``low`` of the inflows and not more.
    """
    left = {day: [cents_out, n_out] for day, _, _, cents_out, n_out in days_of}
    found = []
    for day, cents_in, n_in, _, _ in sorted(days_of):
        if not n_in:
            continue
        reach = [d for d in range(day, day + span) if d in left]
        total_out, n_out = (sum(left[d][i] for d in reach) for i in (0, 1))
        last = max((d for d in reach if left[d][1]), default=day)
        found.append((day, last, cents_in, total_out, n_in, n_out))
        if low * cents_in <= total_out <= cents_in:
            for d in reach:
                left[d] = [0, 0]
    return found


def pass_through(rows: DataFrame, account: str, ts: str, amount: str, leg: str, party: str, order: Sequence[str], span: int = 3, low: float = 0.8, least: float = params.MIN_TRANSACTION) -> DataFrame:
    """Days whose inflows went on within ``span`` days, and days that look odd: account, day, pattern, last_day, total_in, total_out, note.

    pattern is null where less than ``low`` or more than all went on; note says so. Outflows that made a pattern are used
    up. Rows are summed per account and day first, so a group holds the days of an account.
    """
    slim = rows.filter((F.col(amount) >= least) & F.col(leg).isin("IN", "OUT"))
    slim = slim.select(F.col(account).alias("account"), F.floor(seconds(ts) / DAY).alias("day"), cents(F.col(amount)).alias("cents"), (F.col(leg) == "IN").alias("into"), F.col(party).cast("string").alias("party"), F.struct(seconds(ts).alias("t"), *order).alias("place"))
    part = lambda into, value: F.sum(F.when(F.col("into") == into, value).otherwise(0)).cast("long")
    by_day = slim.groupBy("account", "day").agg(
        part(True, F.col("cents")).alias("cents_in"), part(True, F.lit(1)).alias("n_in"), part(False, F.col("cents")).alias("cents_out"), part(False, F.lit(1)).alias("n_out"),
        F.min_by(F.when(F.col("into"), F.col("party")), F.when(F.col("into"), F.col("place"))).alias("first_party"),
    )
    kind = slim.schema["account"].dataType.simpleString()

    def work(table: pa.Table) -> pa.Table:
        days_of = list(zip(*(table[c].to_pylist() for c in ("day", "cents_in", "n_in", "cents_out", "n_out")), strict=True))
        found = consume(days_of, span, low)
        columns = list(zip(*found, strict=True)) if found else [[]] * 6
        out = {"account": pa.array([table["account"][0].as_py()] * len(found), table.schema.field("account").type)}
        return pa.table(out | {n: pa.array(c, pa.int64()) for n, c in zip(("day", "last", "cents_in", "cents_out", "n_in", "n_out"), columns, strict=True)})

    found = by_day.drop("first_party").groupBy("account").applyInArrow(work, f"account {kind}, day long, last long, cents_in long, cents_out long, n_in long, n_out long")
    named = by_day.filter("n_in > 0").select(F.col("account").alias("p_account"), F.col("day").alias("p_day"), "first_party")
    found = found.join(named, (F.col("account") == F.col("p_account")) & (F.col("day") == F.col("p_day")))
    ratio = F.col("cents_out") / F.col("cents_in")
    one_in, one_out = F.col("n_in") == 1, F.col("n_out") == 1
    kinds = F.when(one_in & one_out, "1-to-1 Pass-Through").when(one_out, "Merged Funds").when(one_in, "Split Funds").otherwise("Merged & Split Funds")
    fits = (F.col("cents_out") >= low * F.col("cents_in")) & (F.col("cents_out") <= F.col("cents_in"))
    date = lambda c: F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col(c).cast("int")), "yyyy-MM-dd")
    money = lambda c: F.concat(F.lit("₹"), F.format_number(F.col(c) / 100, 2))
    little = F.concat(F.lit("On "), date("day"), F.lit(", received "), money("cents_in"), F.lit(" from "), F.coalesce("first_party", F.lit("Unknown")), F.lit(", but only passed "), money("cents_out"), F.lit(" ("), F.format_number(half_up(F.col("cents_out") * 100, F.col("cents_in"), 1), 1), F.lit(f"%) within {span} days."))
    much = F.concat(F.lit("On "), date("day"), F.lit(", received "), money("cents_in"), F.lit(", but passed out significantly more: "), money("cents_out"), F.lit(f" within {span} days."))
    note = F.when(fits, None).when((ratio > 0) & (ratio < 1), little).when(ratio > 1, much)
    out = found.withColumn("pattern", F.when(fits, kinds)).withColumn("note", note).filter("pattern is not null or note is not null")
    return out.select("account", date("day").alias("day"), "pattern", date("last").alias("last_day"), (F.col("cents_in") / 100).alias("total_in"), (F.col("cents_out") / 100).alias("total_out"), "note")


def cycle_metrics(cycles: DataFrame, nodes: str, direct: DataFrame, hops: DataFrame) -> DataFrame:
    """Each leg of closed walks with its money: cycle, leg, sender, recipient, outflow, inflow, retained, conduits, first_date, last_date.

    cycles: cycle (an id) and ``nodes``, an array of names without the first one again at its end; direct: sender,
    recipient, amount, date; hops: sender, recipient, conduit, outflow, inflow, out_date, in_date. Transfers are summed per
    pair before they are joined to the legs, so a leg that many cycles share is summed once.
    """
    legs = cycles.select("cycle", F.posexplode(nodes).alias("leg", "sender"), F.col(nodes).alias("_all"))
    nxt = F.element_at("_all", F.col("leg") % F.size("_all") + 1)
    legs = legs.withColumn("leg", F.col("leg") + 1).withColumn("recipient", nxt).drop("_all")
    none = F.lit(None).cast("string")
    zero = F.lit(0).cast("long")
    plain = direct.select("sender", "recipient", cents(F.col("amount")).alias("out_c"), cents(F.col("amount")).alias("in_c"), zero.alias("kept"), none.alias("conduit"), F.col("date").cast("string").alias("a"), F.col("date").cast("string").alias("b"))
    through = hops.select(
        "sender", "recipient", cents(F.col("outflow")).alias("out_c"), cents(F.col("inflow")).alias("in_c"), F.greatest(zero, cents(F.col("outflow")) - cents(F.col("inflow"))).alias("kept"),
        F.col("conduit").cast("string").alias("conduit"), F.col("out_date").cast("string").alias("a"), F.col("in_date").cast("string").alias("b"),
    )
    sums = plain.unionByName(through).groupBy("sender", "recipient").agg(
        F.sum("out_c").alias("out_c"), F.sum("in_c").alias("in_c"), F.sum("kept").alias("kept"), F.array_join(F.array_sort(F.collect_set("conduit")), ", ").alias("conduits"),
        F.least(F.min("a"), F.min("b")).alias("first_date"), F.greatest(F.max("a"), F.max("b")).alias("last_date"),
    )
    out = legs.join(sums, ["sender", "recipient"], "left")
    amount = lambda c: (F.coalesce(F.col(c), zero) / 100)
    return out.select(
        "cycle", "leg", "sender", "recipient", amount("out_c").alias("outflow"), amount("in_c").alias("inflow"), amount("kept").alias("retained"),
        F.coalesce(F.nullif("conduits", F.lit("")), F.lit("Direct Banking")).alias("conduits"), F.coalesce("first_date", F.lit("-")).alias("first_date"), F.coalesce("last_date", F.lit("-")).alias("last_date"),
    )


def cycle_totals(legs: DataFrame) -> DataFrame:
    """Per cycle of ``cycle_metrics``: what left its first node and when, what came back and when, what was retained."""
    return legs.groupBy("cycle").agg(
        F.min_by("outflow", "leg").alias("initial_amount"), F.min_by("first_date", "leg").alias("initial_date"), F.max_by("inflow", "leg").alias("return_amount"),
        F.max_by("last_date", "leg").alias("return_date"), total("retained").alias("retained"),
    )
