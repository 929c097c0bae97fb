import random

from ledgerloom.operators import settlement as S


def inserted(short, long):
    at = 0
    for c in long:
        at += at < len(short) and short[at] == c
    return len(long) - len(short) if at == len(short) else None


def plain(now, base):
    """The rows' titles by trying every scanned title against every earlier one."""
    free = {t for t in base if t not in {t for t, _ in now}}
    marked = [t for t, n in now if n and t not in base]
    met = {t: {b: k for b in free if (k := inserted(b, t)) is not None and 1 <= k < S.MOST_INSERTED + S.MARGIN} for t in set(marked)}
    out = []
    for t, n in now:
        got = t
        if n and met.get(t):
            least = min(met[t].values())
            best = [b for b, k in met[t].items() if k < least + S.MARGIN]
            if least <= S.MOST_INSERTED and len(best) == 1:
                rivals = [x for x in marked if met[x].get(best[0], 99) <= least]
                got = best[0] if rivals == [t] else t
        out.append((got, t if got != t or (n and met.get(t) and got != t) else None))
    return sorted(out, key=str)


def test_scanned_titles_against_all_pairs(spark):
    r = random.Random(3)
    base = {"".join(r.choice("abé") for _ in range(r.randrange(1, 9))) for _ in range(60)} | {"作品" * 12}
    now = []
    for t in sorted(base):
        text = t
        for _ in range(r.choice([0, 1, 1, 2, 3, 4, 5])):
            at = r.randrange(len(text) + 1)
            text = text[:at] + r.choice("abx") + text[at:]
        now.append((text, r.random() < 0.8))
    current = spark.createDataFrame([("c", "EB", t, S.SCANNED_NOTE if n else None) for t, n in now], "channel string, type string, title_jp string, note2 string")
    out = S.reconcile_scanned(current, spark.createDataFrame([("C", "eb", t) for t in base], "channel string, type string, title_jp string"))
    got = sorted(((x.title_jp, x.raw_title) for x in out.collect()), key=str)
    assert got == plain(now, base) and any(raw for _, raw in got)
    assert "_half" in out._jdf.queryExecution().optimizedPlan().toString()  # titles of one length alone do not meet


def test_titles_are_never_broadcast_however_well_they_compress(spark):
    name = "concat('作品', translate(lpad(cast(id as string), 7, '0'), '0123456789', 'abcdefghij'))"
    base = spark.range(3000).selectExpr("'C' AS channel", "'eb' AS type", f"{name} AS title_jp")
    noisy = f"CASE WHEN id % 3 = 0 THEN concat(substr({name}, 1, 4), '口', substr({name}, 5)) ELSE {name} END"
    current = spark.range(3000).selectExpr("'c' AS channel", "'EB' AS type", f"{noisy} AS title_jp", f"CASE WHEN id % 3 = 0 THEN '{S.SCANNED_NOTE}' END AS note2")
    out = S.reconcile_scanned(current, base)
    assert sum(x.raw_title is not None for x in out.collect()) == 1000
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    met = [x for x in plan.splitlines() if "BroadcastHashJoin" in x]
    assert met and not [x for x in met if "_title" in x or "_base" in x] and "SortMergeJoin" in plan
