"""A sample whose categories have target shares.

Categories form a tree: the first field's categories above those of the second. Quotas
are allotted from the top down. What a leaf cannot fill goes to its siblings first, and
what they cannot fill to its cousins, in proportion to their own targets; then quota is
exchanged between siblings until the second field's targets and minima are met as far as
rows allow. Leaves are drawn by the rank of their rows in a fixed permutation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.ranking import take_by_permutation


def category(value: Column, field: str) -> Column:
    """Subjects trimmed in lower case; answers trimmed in upper case without a final full stop; null for empty."""
    t = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    if field == "answer":
        t = F.regexp_replace(F.regexp_replace(F.upper(t), r"\.$", ""), r"(?U)\s+$", "")
    else:
        t = F.lower(t)
    return F.nullif(t, F.lit(""))


def allot(have: dict[str, int], weight: dict[str, float], floor: dict[str, int], total: int) -> dict[str, int]:
    """Whole quotas that sum to the total as far as rows allow.

    Each key gets its floor first, then its weighted part; what a key cannot fill is
    shared among the others in proportion to their weights, keys without weight last.
    Remainders go to the largest fractions, ties by name.
    """
    quota = {k: min(have[k], floor.get(k, 0)) for k in have}
    left = total - sum(quota.values())
    for k in sorted(quota, key=lambda k: (-quota[k], k)):  # floors over the total: the largest give way first
        back = min(quota[k], max(0, -left))
        quota[k] -= back
        left += back
    goal = {k: weight.get(k, 0) * total for k in have}
    while left > 0:
        open_keys = [k for k in have if quota[k] < have[k]]
        if not open_keys:
            break
        short = {k: max(0.0, goal[k] - quota[k]) for k in open_keys}
        if not sum(short.values()):
            short = {k: weight.get(k, 0) for k in open_keys}
        if not sum(short.values()):
            short = {k: float(have[k] - quota[k]) for k in open_keys}
        scale = min(1.0, left / sum(short.values())) if sum(short.values()) >= left else left / sum(short.values())
        part = {k: min(have[k] - quota[k], int(short[k] * scale)) for k in open_keys}
        if not any(part.values()):
            order = sorted(open_keys, key=lambda k: (-(short[k] * scale), k))
            for k in [k for k in order if short[k] > 0][:left]:
                quota[k] += 1
                left -= 1
            continue
        for k, n in part.items():
            quota[k] += n
            left -= n
    return quota


OTHER = "\u0000other"
Leaf = tuple[str | None, str | None]


def _give(have: dict[Leaf, int], quota: dict[Leaf, int], keys: list[Leaf], weight: dict[Leaf, float], n: int) -> int:
    """Adds up to n to the quotas of leaves that have rows left, rows without a category last; returns what is left of n."""
    for named in (True, False):
        free = {k: have[k] - quota[k] for k in keys if (None not in k) == named and have[k] > quota[k]}
        names = {repr(k): k for k in free}
        for name, v in allot({x: free[k] for x, k in names.items()}, {x: weight.get(k, 0.0) for x, k in names.items()}, {}, n).items():
            quota[names[name]] += v
            n -= v
    return n


def _exchange(have: dict[Leaf, int], quota: dict[Leaf, int], goal: dict[str, int]) -> None:
    """Moves quota between siblings until no answer over its goal can make up for one under it, directly or through others.

    Totals of the first field stay as they are.
    """
    tops, answers = sorted({s for s, _ in have}, key=repr), sorted({b for _, b in have}, key=repr)
    total = {b: sum(v for (_, x), v in quota.items() if x == b) for b in answers}

    def room(a: str | None, b: str | None) -> tuple[int, str | None]:
        """The most that one category of the first field can move from a to b."""
        return max(((min(quota[s, a], have[s, b] - quota[s, b]), s) for s in tops if (s, a) in have and (s, b) in have), key=lambda x: x[0], default=(0, None))

    while True:
        over = [b for b in answers if total[b] > goal.get(b, 0)]
        under = {b for b in answers if total[b] < goal.get(b, 0)}
        came: dict = {b: b for b in over}
        queue, end = list(over), None
        while queue and end is None:
            a = queue.pop(0)
            for b in answers:
                if b not in came and room(a, b)[0] > 0:
                    came[b] = a
                    queue.append(b)
                    if b in under:
                        end = b
                        break
        if end is None:
            return
        path = [end]
        while came[path[-1]] != path[-1]:
            path.append(came[path[-1]])
        path.reverse()
        amount = min(total[path[0]] - goal.get(path[0], 0), goal[end] - total[end])
        for a, b in zip(path, path[1:]):
            amount = min(amount, room(a, b)[0])
        for a, b in zip(path, path[1:]):
            # no more goes on than came, so what is short at the end gets less so in every round
            most, s = room(a, b)
            amount = min(amount, most)
            if not amount:
                return
            quota[s, a] -= amount
            quota[s, b] += amount
            total[a] -= amount
            total[b] += amount


def allot_tree(have: dict[Leaf, int], weights: tuple[dict, dict], floors: tuple[dict, dict], total: int) -> dict[Leaf, int]:
    """Whole quotas of the leaves that sum to the total as far as there are rows.

    have: rows of each (first category, second category), None and OTHER for rows without a
    category or target. weights, floors: of the categories of each field, present or not.
    """
    top = allot({k: total for k in {*weights[0], *floors[0]}}, *(weights[0], floors[0]), total) if weights[0] or floors[0] else {}
    if not top:  # no targets above: what there is, is wanted
        rows = {}
        for (s, _), n in have.items():
            rows[s or ""] = rows.get(s or "", 0) + n
        top = {s or None: v for s, v in allot(rows, {k: n / max(1, sum(rows.values())) for k, n in rows.items()}, {}, total).items()}
    quota, left = dict.fromkeys(have, 0), {}
    for s, n in sorted(top.items(), key=repr):
        own = {b or "": v for (x, b), v in have.items() if x == s}
        under = weights[1] or {b: v / max(1, sum(own.values())) for b, v in own.items()}
        for b, want in allot({b: n for b in under}, under, {}, n).items():
            leaf = (s, b or None)
            quota[leaf] = min(want, have.get(leaf, 0))
            left[leaf] = want - quota[leaf]
            have.setdefault(leaf, 0)
        if not under:
            left[s, None] = n
    by_second = {k: weights[1].get(k[1], 0.0) for k in have}
    by_first = {k: weights[0].get(k[0], 0.0) for k in have}
    for leaf in sorted(left, key=repr):
        left[leaf] = _give(have, quota, [k for k in have if k[0] == leaf[0] and k != leaf], by_second, left[leaf])
    for leaf in sorted(left, key=repr):
        rest = _give(have, quota, [k for k in have if k[1] == leaf[1] and k[0] != leaf[0] and k[0] is not None], by_first, left[leaf])
        rest = _give(have, quota, [k for k in have if k[0] is not None and by_first[k] > 0], by_first, rest)
        _give(have, quota, list(have), by_first, rest)
    # whole goals of the second field, minima first
    goal = allot({k: total for k in {*weights[1], *floors[1]}}, weights[1], floors[1], total) if weights[1] or floors[1] else {}
    if goal:
        _exchange(have, quota, goal)
    return quota


def draw_sample(df: DataFrame, targets: DataFrame, parent: Column, child: Column, names: tuple[str, str] = ("subject", "answer"), id_column: str = "row_id", share: float = 0.5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(sample, report): share of the rows of df, meeting the targets of both fields as far as the rows allow.

    The sample has df's columns and the two categories; its size is floor(share * rows),
    less only if there are no more rows. Rows without a category of the second field come after
    their siblings, rows without one of the first are drawn only when all others are used. Where targets of the two fields compete for the same rows, those of the first
    win. The report has, for each target, the rows of the category (records), wanted and
    drawn rows, counted in the sample, whether the target is met, and missed: why not,
    'rows' where the category has too few for its share or its minimum, 'conflict' where
    other targets take its place. What a category can't fill goes to others, so these may
    have more than wanted. Repeated targets count once and are each reported.
    The category tree is as large as the targets, not as the rows or their categories;
    quotas are worked out on the driver from its counts.
    """
    p, c = names
    rows = df.withColumn(f"_{p}", category(parent, p)).withColumn(f"_{c}", category(child, c))
    # categories without a target are one leaf each per field, so the tree stays as small as the targets
    t = [r.asDict() for r in targets.collect()]
    asked = {f: {r["category"]: r for r in t if r["target_field"] == f} for f in names}
    for f in names:
        rows = rows.withColumn(f"_{f}", F.when(F.col(f"_{f}").isin(list(asked[f])), F.col(f"_{f}")).otherwise(F.when(F.col(f"_{f}").isNotNull(), OTHER)))
    counts = rows.groupBy(f"_{p}", f"_{c}").agg(F.count("*").alias("n")).collect()
    have = {(r[0], r[1]): r[2] for r in counts}
    n = sum(have.values())
    total = int(n * share)
    weights = tuple({k: (r["target_permille"] or 0) / 1000 for k, r in asked[f].items()} for f in names)
    floors = tuple({k: r["min_rows"] or 0 for k, r in asked[f].items()} for f in names)
    quota = allot_tree(dict(have), weights, floors, total)
    schema = f"_{p} string, _{c} string, quota bigint"
    quotas = df.sparkSession.createDataFrame([(a, b, v) for (a, b), v in quota.items() if v] or [(None, None, 0)], schema)
    sample = take_by_permutation(rows, [f"_{p}", f"_{c}"], id_column, quotas, seed=seed)
    sample = sample.select(*df.columns, F.nullif(F.col(f"_{p}"), F.lit(OTHER)).alias(f"{p}_category"), F.nullif(F.col(f"_{c}"), F.lit(OTHER)).alias(f"{c}_category"))
    records = {(f, k): sum(v for leaf, v in have.items() if leaf[at] == k) for at, f in enumerate(names) for k in asked[f]}
    wanted = [(n_, r["target_field"], r["category"], records.get((r["target_field"], r["category"]), 0), (r["target_permille"] or 0) * share * n / 1000, r["min_rows"] or 0, (r["target_permille"] or 0) * n) for n_, r in enumerate(t)]
    goals = df.sparkSession.createDataFrame(wanted, "_n int, target_field string, category string, records bigint, wanted double, min_rows int, _share bigint")
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("_f"), F.col(f"{f}_category").alias("_k")) for f in names)))
    drawn = sample.select(each.alias("x")).groupBy("x._f", "x._k").agg(F.count("*").alias("_d")).filter("_k is not null")
    met = (F.col("drawn") >= F.col("min_rows")) & (F.col("drawn") > F.col("wanted") - 1)
    scarce = (F.col("records") * 1000 < F.col("_share") * share) | (F.col("records") < F.col("min_rows"))
    report = goals.join(F.broadcast(drawn), (F.col("target_field") == F.col("_f")) & (F.col("category") == F.col("_k")), "left").withColumn("drawn", F.coalesce("_d", F.lit(0)))
    report = report.withColumn("missed", F.when(scarce, "rows").when(~met, "conflict")).withColumn("met", met)
    return sample, report.select("target_field", "category", "records", "wanted", "min_rows", "drawn", "met", "missed")
