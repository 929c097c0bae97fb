"""The settlement ledger: duplicates, upserts, carry-forward, precedence of sources, comparison with an answer key."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.functions.text import meaning, semantic_plain


def strict_key(*columns: str) -> Column:
    """Identity of a row: normalised parts, blank and null alike, numbers in one spelling."""
    part = lambda c: F.coalesce(F.when(F.trim(F.col(c).cast("string")).try_cast("double").isNotNull(), F.trim(F.col(c).cast("string")).try_cast("double").cast("string")).otherwise(F.trim(F.col(c).cast("string"))), F.lit(""))
    return F.concat_ws("␟", *map(part, columns))


def suppress_existing(incoming: DataFrame, existing: DataFrame, keys: list[str], order: list[str], party: list[str] | None = None) -> DataFrame:
    """Multiset difference by ``keys``: as many rows of a key go as ``existing`` has; rows without a party always stay."""
    have = existing.groupBy(*keys).agg(F.count("*").alias("_have"))
    same = reduce(lambda a, b: a & b, (F.col(f"i.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys))
    out = incoming.alias("i").join(have.alias("e"), same, "left").select("i.*", F.coalesce("e._have", F.lit(0)).alias("_have"))
    out = out.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    unsafe = reduce(lambda a, b: a & b, (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "" for c in party)) if party else F.lit(False)
    return out.where((F.col("_at") > F.col("_have")) | unsafe).drop("_at", "_have")


def largest_upload(rows: DataFrame, keys: list[str], upload: str = "upload_id") -> DataFrame:
    """Of each key, the rows of the upload with most of them; of equals, the smallest id, null first."""
    # dealt out by the keys and sorted once, for both windows
    own = rows.repartition(*keys).withColumn("_n", F.count("*").over(Window.partitionBy(*keys, upload)))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(upload).isNotNull().alias("known"), F.col(upload).alias("id")))
    return own.withColumn("_best", best.over(Window.partitionBy(*keys))["id"]).where(F.col(upload).eqNullSafe(F.col("_best"))).select(*rows.columns)


def duplicate_audit(rows: DataFrame, group: str, keys: list[str], upload: str = "upload_id") -> DataFrame:
    each = rows.groupBy(group, *(k for k in keys if k != group)).agg(F.count("*").alias("n"), F.min(upload).alias("lo"), F.max(upload).alias("hi"))
    return each.groupBy(group).agg(F.sum("n").alias("row_count"), F.count("*").alias("key_groups"), F.count_if(F.col("n") > 1).alias("dup_groups"), F.count_if(F.col("lo") != F.col("hi")).alias("cross_upload_groups"))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], replace: list[str], keep_old_if_null: list[str]) -> DataFrame:
    """The table after the upsert, with ``action``; both sides have one row a key."""
    joined = existing.alias("o").join(incoming.alias("n"), keys, "full")
    has_new = F.coalesce(*(F.col(f"n.{c}").isNotNull() for c in replace))
    has_old = F.coalesce(*(F.col(f"o.{c}").isNotNull() for c in replace))
    cols = [F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in [*replace, *keep_old_if_null]]
    return joined.select(*keys, *cols, F.when(has_new & has_old, "updated").when(has_new, "inserted").otherwise("kept").alias("action"))


def fold_batch(rows: DataFrame) -> DataFrame:
    """Rows of one title, channel and day become one, amounts added."""
    return rows.groupBy("title_jp", "channel", "sale_date").agg(F.sum("sales_amount").alias("sales_amount"), F.sum("sales_amount_gross").alias("sales_amount_gross"))


def source_precedence(stored: DataFrame, confirmed: DataFrame, preliminary: DataFrame) -> DataFrame:
    """What is stored outside the confirmed rows' days, the confirmed rows, and preliminary rows whose key they lack."""
    span = confirmed.agg(F.min("sale_date").alias("lo"), F.max("sale_date").alias("hi"))
    kept = stored.crossJoin(F.broadcast(span)).where("lo is null or sale_date < lo or sale_date > hi").select(*stored.columns)  # one row
    late = preliminary.join(confirmed.select("title_jp", "channel", "sale_date"), ["title_jp", "channel", "sale_date"], "left_anti").select(*stored.columns)
    return kept.unionByName(confirmed.select(*stored.columns)).unionByName(late)


def replace_range(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Cumulative files: rows of the same channel and source within the incoming days go first."""
    span = incoming.groupBy("channel", "data_source").agg(F.min("sale_date").alias("lo"), F.max("sale_date").alias("hi"))
    gone = (F.col("s.channel") == F.col("x.channel")) & (F.col("s.data_source") == F.col("x.data_source")) & F.col("s.sale_date").between(F.col("x.lo"), F.col("x.hi"))
    return stored.alias("s").join(span.alias("x"), gone, "left_anti").unionByName(incoming.select(*stored.columns))


def unseen_titles(rows: DataFrame, titles: DataFrame) -> DataFrame:
    return rows.select("title_jp").distinct().join(titles, "title_jp", "left_anti")


def batch_summary(ledger: DataFrame, *keys: str) -> DataFrame:
    income = F.sum(money.half_up(F.col("gross") * F.col("rate")))
    return ledger.groupBy(*keys).agg(F.count("*").alias("row_count"), F.sum("gross").alias("gross"), income.alias("income"), F.coalesce(F.sum("fee"), F.lit(0)).alias("fee"))


def rate_for(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` with the rule of each: of those whose months hold it, that of least priority number, then the latest.

    ``rules``: rule_id, client_id, effective_from, effective_to (null: open), priority, rule_rate. Rows that no rule
    holds stay, with nulls. Rules are taken once a client and month, so that equal rows stay apart and the rows
    themselves are not multiplied.
    """
    asked = rows.select("client_id", "batch").distinct()
    held = (F.col("r.batch") >= F.col("q.effective_from")) & (F.col("q.effective_to").isNull() | (F.col("r.batch") <= F.col("q.effective_to")))
    met = asked.alias("r").join(rules.alias("q"), (F.col("r.client_id") == F.col("q.client_id")) & held)
    order = Window.partitionBy("_client", "_batch").orderBy("priority", F.desc("effective_from"), "rule_id")  # a client's rules
    found = met.select(F.col("r.client_id").alias("_client"), F.col("r.batch").alias("_batch"), "q.rule_id", "q.priority", "q.effective_from", "q.rule_rate").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return rows.join(found, (F.col("client_id") == F.col("_client")) & (F.col("batch") == F.col("_batch")), "left").drop("_client", "_batch")


def settle(rows: DataFrame, tax: float = 0.1, krw: float = 9.2) -> DataFrame:
    """Tax, share and currency of each ledger row."""
    income = money.half_up(F.col("gross") * F.col("rate"))
    return rows.withColumns({"after_tax": money.net_of(F.col("gross"), tax), "income": income}).withColumns({"consumption_tax": money.down(F.col("income") * tax), "income_krw": money.half_up(F.col("income") * krw)})


def draw_down(rows: DataFrame, balances: DataFrame, order: list[str], key: str = "title_jp", balance_key: str = "title_jp") -> DataFrame:
    """Advances of a title set against its incomes in row order: ``begin`` and ``decrease`` of each row.

    After a row max(begin - income, 0) is left, so that a negative income adds to the advance. Unrolled, a row begins
    with max(balance, the largest sum of incomes up to any earlier row) less the sum up to the row before: two windows
    over one sort. Titles without a balance have 0. So have rows without a title, which no window sees.
    """
    sums = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    one = balances.groupBy(F.col(balance_key).alias("_balance_key")).agg(F.max("balance").alias("balance"))
    zero = F.lit(0)
    titled = rows.where(F.col(key).isNotNull()).join(one, F.col(key) == F.col("_balance_key"), "left").drop("_balance_key").withColumn("balance", F.coalesce("balance", zero))
    titled = titled.withColumn("_earlier", F.coalesce(F.sum("income").over(sums), zero))
    # the sums before the rows so far, of which the first is 0 and counts only through the balance
    top = F.max("_earlier").over(sums.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    titled = titled.withColumn("begin", F.greatest(F.col("balance"), top) - F.col("_earlier")).drop("_earlier")
    kind = {c: titled.schema[c].dataType for c in ("balance", "begin")}
    untitled = rows.where(F.col(key).isNull()).withColumns({c: zero.cast(t) for c, t in kind.items()})
    return titled.unionByName(untitled).withColumn("decrease", F.least("begin", "income"))


def latest_roster(rows: DataFrame, keys: list[str], batch: str, before: str) -> DataFrame:
    """All rows of each key's latest batch before ``before``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(batch))
    return rows.where(F.col(batch) < before).withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")


def carry_forward(base: DataFrame, current: DataFrame, keys: list[str], order: list[str], contract: list[str], money_columns: list[str]) -> DataFrame:
    """Base rows paired with current ones by place within their key: overlay, carry (amounts emptied) or append."""
    at = lambda d: d.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).withColumn("_has", F.lit(True))
    j = at(base).alias("b").join(at(current).alias("c"), [*keys, "_n"], "full")
    action = F.when(F.col("b._has") & F.col("c._has"), "overlay").when(F.col("b._has"), "carry").otherwise("append")
    return j.select(*keys, F.col("_n").alias("place"), action.alias("action"), *(F.coalesce(f"b.{c}", f"c.{c}").alias(c) for c in contract), *(F.col(f"c.{c}").alias(c) for c in money_columns))


def month_roster_modes(rows: DataFrame, group: str, attribute: str, order: str) -> DataFrame:
    """The most frequent value in each group; of equals, the one seen first."""
    c = rows.groupBy(group, attribute).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    return c.groupBy(group).agg(F.min_by(attribute, F.struct(-F.col("n"), F.col("seen"), F.col(attribute))).alias(attribute))


def missing_families(required: DataFrame, uploads: DataFrame) -> DataFrame:
    """Families that the baseline has and no successful upload with rows covers."""
    return required.join(uploads.where("status in ('parsed', 'aggregated') and parsed_rows > 0").select("family"), "family", "left_anti")


def assign(cost: np.ndarray) -> list[int]:
    """The column of each row in a least-cost pairing (shortest augmenting paths); rows are no more than columns."""
    n, m = cost.shape
    u, v, row_of = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while row_of[j0]:
            used[j0] = True
            r = row_of[j0]
            slack = cost[r - 1] - u[r] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], back[1:][better] = slack[better], j0
            j1 = int(np.where(used[1:], np.inf, least[1:]).argmin()) + 1
            step = least[j1]
            u[row_of[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
        while j0:
            row_of[j0], j0 = row_of[back[j0]], back[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out


def compare_sheets(ours: DataFrame, key: DataFrame, identity: list[str], fields: list[str], most: int = 150) -> DataFrame:
    """(identity, category, field, ours, theirs): differences under the pairing that has fewest of them.

    Cells are compared by what they mean (``text.semantic``), and shown as they are.

    Rows of one identity are few by contract; beyond ``most`` the pairing raises an error. Order does not matter. The
    rows come to a task in order of their identities: those with a row on each side, or on one side alone, leave nothing
    to pair and are compared many at once; only the others are taken one by one.
    """
    names = [*identity, "category", "field", "ours", "theirs"]
    texts = [[dict(d.dtypes)[c] == "string" for d in (ours, key)] for c in fields]

    def side(d: DataFrame, theirs: bool) -> DataFrame:
        kinds = dict(d.dtypes)
        cells = (c for i, f in enumerate(fields) for c in (F.col(f).cast("string").alias(f"_raw{i}"), semantic_plain(F.col(f), kinds[f]).alias(f"_meant{i}")))
        return d.select(*(F.col(k).cast("string").alias(k) for k in identity), F.lit(theirs).alias("_theirs"), *cells)

    def same(x, y):
        """Whether two cells mean the same, numbers within a relative 1e-7; null where one is not known."""
        if x is None or y is None:
            return None
        if x[:2] == y[:2] == "n:":
            p, q = float(x[2:]), float(y[2:])
            return p == q or abs(p - q) <= 1e-7 * max(1, abs(p), abs(q))
        return x == y

    def differ(x, y):
        """Where ``same`` is false, of many cells."""
        out = pc.fill_null(pc.not_equal(x, y), False).to_numpy(zero_copy_only=False)
        numbers = pc.fill_null(pc.and_(pc.starts_with(x, "n:"), pc.starts_with(y, "n:")), False).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(numbers & (out | pc.fill_null(pc.equal(x, "n:NaN"), False).to_numpy(zero_copy_only=False)))
        p, q = (np.array(pc.utf8_slice_codeunits(v.take(pa.array(at)), 2).to_pylist(), float) for v in (x, y))
        with np.errstate(invalid="ignore"):
            out[at] = ~((p == q) | (np.abs(p - q) <= 1e-7 * np.maximum(1, np.maximum(np.abs(p), np.abs(q)))))
        return out

    def differences(a, b):
        """(category, field, ours, theirs) of the rows of one identity, each a list of (raw, meant)."""
        a, b = (sorted(d, key=lambda r: [(x[0] or "", x[0] is not None) for x in r]) for d in (a, b))
        flip = len(a) > len(b)
        small, large = (b, a) if flip else (a, b)
        verdicts = [[[same(x[1], y[1]) for x, y in zip(r, s, strict=True)] for s in large] for r in small]
        cost = [[(any(v is not True for v in p)) * 1e6 + sum(v is False for v in p) * 1e3 + sum(v is None for v in p) for p in row] for row in verdicts]
        pairs = assign(np.array(cost, float))
        for i, j in enumerate(pairs):
            for f, v, x, y in zip(fields, verdicts[i][j], small[i], large[j], strict=True):
                if v is False:
                    yield ("field", f, *((y[0], x[0]) if flip else (x[0], y[0])))
        for _ in range(len(large) - len(pairs)):
            yield ("extra" if flip else "missing", None, None, None)

    def normal(rows, i, theirs):
        """Meanings of a field with those of its texts that must be normalised first (``semantic_plain`` does not)."""
        raw, meant = rows.column(f"_raw{i}"), rows.column(f"_meant{i}")
        if not any(texts[i]):
            return meant
        odd = pc.fill_null(pc.invert(pc.string_is_ascii(raw)), False).to_numpy(zero_copy_only=False) & np.where(theirs, texts[i][1], texts[i][0])
        if not odd.any():
            return meant
        return pc.replace_with_mask(meant, pa.array(odd), pa.array(map(meaning, raw.filter(pa.array(odd)).to_pylist()), pa.string()))

    def compared(rows):
        """The differences of whole identities, rows in their order."""
        theirs = rows.column("_theirs").to_numpy(zero_copy_only=False)
        start = np.flatnonzero(np.concatenate([[True], changes(rows)]))
        size = np.diff(np.append(start, len(theirs)))
        n_b = np.add.reduceat(theirs.astype(np.int64), start)
        n_a = size - n_b
        if (np.maximum(n_a, n_b) > most).any():
            at = int(start[np.argmax(np.maximum(n_a, n_b) > most)])
            raise ValueError(f"{tuple(rows.column(k)[at].as_py() for k in identity)}: more than {most} rows of one identity")
        raws = [rows.column(f"_raw{i}") for i in range(len(fields))]
        meant = [normal(rows, i, theirs) for i in range(len(fields))]

        def made(at, *cells):
            kinds = [c if isinstance(c, pa.Array) else pa.array([c] * len(at), pa.string()) for c in cells]
            return pa.RecordBatch.from_arrays([*(rows.column(k).take(pa.array(at)) for k in identity), *kinds], names=names)

        alone = np.flatnonzero(np.repeat((n_a == 0) | (n_b == 0), size))
        yield made(alone, pa.array(np.where(theirs[alone], "missing", "extra").tolist(), pa.string()), None, None, None)
        pairs = start[(n_a == 1) & (n_b == 1)]  # our row, then theirs
        for f, raw, m in zip(fields, raws, meant, strict=True):
            at = pairs[differ(m.take(pa.array(pairs)), m.take(pa.array(pairs + 1)))]
            yield made(at, "field", f, raw.take(pa.array(at)), raw.take(pa.array(at + 1)))
        several = np.flatnonzero((n_a > 0) & (n_b > 0) & (size > 2))
        own = np.flatnonzero(np.isin(np.repeat(np.arange(len(start)), size), several))
        cells = list(zip(*(zip(r.take(pa.array(own)).to_pylist(), m.take(pa.array(own)).to_pylist(), strict=True) for r, m in zip(raws, meant, strict=True)), strict=True))
        places, found, done = [], [], 0
        for g in several.tolist():
            here, done = cells[done : done + size[g]], done + size[g]
            more = list(differences(here[: n_a[g]], here[n_a[g] :]))
            places += [start[g]] * len(more)
            found += more
        if found:
            yield made(np.array(places), *(pa.array(c, pa.string()) for c in zip(*found, strict=True)))

    def changes(rows):
        """Where a row's identity is not that of the row before."""
        out = np.zeros(max(rows.num_rows - 1, 0), bool)
        for k in identity:
            c = rows.column(k)
            x, y = c.slice(1), c.slice(0, max(rows.num_rows - 1, 0))
            out |= pc.fill_null(pc.not_equal(x, y), False).to_numpy(zero_copy_only=False) | pc.xor(x.is_null(), y.is_null()).to_numpy(zero_copy_only=False)
        return out

    def run(batches):
        held = None  # rows of the last identity so far, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            last = np.flatnonzero(changes(batch))
            cut = int(last[-1]) + 1 if len(last) else 0
            if batch.num_rows - cut > 2 * most:
                raise ValueError(f"{tuple(batch.column(k)[cut].as_py() for k in identity)}: more than {most} rows of one identity")
            held = batch.slice(cut)
            if cut:
                yield from compared(batch.slice(0, cut))
        if held is not None:
            yield from compared(held)

    both = side(ours, False).unionByName(side(key, True)).repartition(*identity).sortWithinPartitions(*identity, "_theirs")
    return both.mapInArrow(run, ", ".join(f"`{n}` string" for n in names))


def reconcile_companions(rows: DataFrame, roles: DataFrame, keys: list[str], order: list[str], overlay: list[str], upload: str = "upload_id") -> DataFrame:
    """Statements of one key in several uploads. Where both roles are there, the detail's largest upload is the base and
    the summary's largest one is laid over it, row by row in ``order``: its ``overlay`` fields that are not blank win, rows
    that only one side has stay. Else the largest upload stays. Keys with one upload stay as they are.

    ``roles``: ``upload``, role ('publisher_detail' or 'broker_summary'); other uploads play none.
    """
    # roles in a stage of their own: where they come from the rows, one task would sort those for both
    own = rows.join(roles.select(upload, "role").repartition("role", upload), upload, "left").repartition(*keys)
    # one sort by key, upload and order serves all windows: a role's upload is one, so that places are those within it
    party, line = Window.partitionBy(*keys), Window.partitionBy(*keys, upload)
    own = own.withColumn("_at", F.row_number().over(line.orderBy(*order)))
    own = own.withColumn("_n", F.count("*").over(line)).withColumn("_place", F.dense_rank().over(party.orderBy(upload)))
    largest = lambda cond: F.min(F.when(cond, F.struct((-F.col("_n")).alias("n"), F.col(upload).alias("id")))).over(party)["id"]
    met = own.withColumns({"_uploads": F.max("_place").over(party), "_any": largest(F.lit(True)), "_base": largest(F.col("role") == "publisher_detail"), "_over": largest(F.col("role") == "broker_summary")})
    paired = (F.col("_uploads") > 1) & F.col("_base").isNotNull() & F.col("_over").isNotNull()
    side = F.when(~paired, F.when((F.col("_uploads") == 1) | (F.col(upload) == F.col("_any")), 0)).when(F.col(upload) == F.col("_base"), 0).when(F.col(upload) == F.col("_over"), 1)
    kept = met.withColumns({"_side": side, "_paired": paired}).where("_side is not null").select(*rows.columns, "_side", "_paired", "_at")
    single = kept.where("not _paired").select(*rows.columns)
    both = kept.where("_paired").repartition(*keys, "_at")  # by themselves, so that no task sorts all rows twice
    pair = both.groupBy(*keys, "_at").agg(*(F.max(F.when(F.col("_side") == s, F.struct(*rows.columns))).alias(n) for s, n in ((0, "_b"), (1, "_o"))))

    def cell(c: str) -> Column:
        first = F.when(F.col("_b").isNotNull(), F.col(f"_b.{c}")).otherwise(F.col(f"_o.{c}"))
        if c not in overlay:
            return first.alias(c)
        over = F.col(f"_o.{c}")
        return F.when(F.trim(over.cast("string")) != "", over).otherwise(first).alias(c)

    return single.union(pair.select(*map(cell, rows.columns)))


def title_aliases(base: DataFrame, least: int = 8) -> DataFrame:
    """(channel, alias, canonical): signatures of ``base`` (channel, canonical, signature), and for those of ``least`` signs
    or more each deletion of one sign and of one or two last punctuation marks. canonical is null where titles collide."""
    s, n = F.col("signature"), F.char_length("signature")
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, n)))
    mark = r"\p{P}$"
    ends = F.when(s.rlike(r"\p{P}\p{P}$"), F.array(F.substring(s, F.lit(1), n - 1), F.substring(s, F.lit(1), n - 2))).when(s.rlike(mark), F.array(F.substring(s, F.lit(1), n - 1))).otherwise(F.array().cast("array<string>"))
    all_ = F.when(n >= least, F.concat(F.array(s), cut, ends)).otherwise(F.array(s))
    rows = base.where(n > 0).select("channel", "canonical", F.explode(F.array_distinct(all_)).alias("alias"))
    one = F.when(F.min("canonical") == F.max("canonical"), F.min("canonical"))
    return rows.groupBy("channel", "alias").agg(one.alias("canonical"))


def consolidate_siblings(rows: DataFrame, keys: list[str], money_columns: list[str], source: str) -> DataFrame:
    """Rows of one key as one: amounts added where any is there, other columns from the least row, and its sources."""
    rest = [c for c in rows.columns if c not in {*keys, *money_columns}]
    least = F.min_by(F.struct(*rest), F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}))
    sources = F.array_sort(F.collect_set(F.when(F.trim(F.col(source).cast("string")) != "", F.col(source).cast("string"))))
    out = rows.groupBy(*keys).agg(least.alias("_r"), *(F.sum(m).alias(m) for m in money_columns), F.count("*").alias("source_count"), F.concat_ws(",", sources).alias("sources"))
    return out.select(*(c if c not in rest else F.col(f"_r.{c}").alias(c) for c in rows.columns), "source_count", "sources")
