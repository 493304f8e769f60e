"""Queries of detection metrics: order lines are boxes, and their parts move, rename, repeat and drop what a model finds of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import canvas
from plumbline.operators import detection, pictures
from plumbline.plans.registry import query, table

# the same text for both engines; {d} makes a literal a double
_LEFT, _TOP = "(l_partkey % 64) * 3.0{d}", "(l_suppkey % 8) * 5.0{d}"
_WIDE, _HIGH = "(16.0{d} + l_discount * 1200.0{d})", "(16.0{d} + l_tax * 1500.0{d})"
_SURE = "((l_partkey * 7919 + l_linenumber * 31) % 1000) / 1000.0{d}"
_SHIFT = "(l_partkey % 9 - 2) * {step}{d}"
_CLASS = "case when l_partkey % 11 = 0 then 'N' else l_returnflag end"
FOUND, AGAIN = "l_partkey % 13 <> 0", "l_suppkey % 5 = 0"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as true boxes, in pixels."""
    e = lambda text: F.expr(text.format(d="D"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_returnflag").alias("class_id"), e(_LEFT).alias("left"), e(_TOP).alias("top"), e(f"{_LEFT} + {_WIDE}").alias("right"), e(f"{_TOP} + {_HIGH}").alias("bottom"))


def findings(spark: SparkSession, sf_dir: str, step: float = 1.5) -> DataFrame:
    """What a model finds: boxes moved to the side by up to six steps, some of another class, some missed, some found twice."""
    e = lambda text: F.expr(text.format(d="D", step=step))
    lines = table(spark, sf_dir, "lineitem")
    made = None
    for rows, shift, sure in ((lines.where(FOUND), _SHIFT, _SURE), (lines.where(AGAIN), "12.0{d}", _SURE + " / 2.0{d}")):
        box = [e(f"{_LEFT} + {shift}").alias("left"), e(_TOP).alias("top"), e(f"{_LEFT} + {_WIDE} + {shift}").alias("right"), e(f"{_TOP} + {_HIGH}").alias("bottom")]
        one = rows.select(F.col("l_orderkey").alias("image"), e(_CLASS).alias("class_id"), *box, e(sure).alias("conf"))
        made = one if made is None else made.unionByName(one)
    return made


def _boxes_sql(step: float) -> str:
    f = lambda text: text.format(d="::double", step=step)
    found = lambda where, shift, sure: f(f"select l_orderkey as image, {_CLASS} as class_id, {_LEFT} + {shift} as l, {_TOP} as t, {_LEFT} + {_WIDE} + {shift} as r, {_TOP} + {_HIGH} as b, {sure} as conf from lineitem where {where}")
    return f"""
    truth as (select l_orderkey as image, l_returnflag as class_id, {f(_LEFT)} as l, {f(_TOP)} as t, {f(f'{_LEFT} + {_WIDE}')} as r, {f(f'{_TOP} + {_HIGH}')} as b from lineitem),
    guess as ({found(FOUND, _SHIFT, _SURE)} union all {found(AGAIN, '12.0{d}', _SURE + ' / 2.0{d}')})"""


def _precision_sql(name: str, truth: str = "truth", guess: str = "guess", spans=None) -> str:
    """Named subqueries ending in {name} (bucket, class_id, n_truth, ap50, ap, precision, recall)."""
    buckets = ", ".join(f"('{b}', {low}::double, {'1e300' if high == float('inf') else high}::double)" for b, low, high in spans or [("", -1.0, float("inf"))])
    inside = lambda box: f"(({box}).r - ({box}).l) * (({box}).b - ({box}).t) >= low and (({box}).r - ({box}).l) * (({box}).b - ({box}).t) < high"
    inner = "(greatest(0.0::double, least(p.r, ts[j].r) - greatest(p.l, ts[j].l)) * greatest(0.0::double, least(p.b, ts[j].b) - greatest(p.t, ts[j].t)))"
    union = "((p.r - p.l) * (p.b - p.t) + (ts[j].r - ts[j].l) * (ts[j].b - ts[j].t) - {i})".format(i=inner)
    return f"""
    {name}_b(bucket, low, high) as (values {buckets}),
    {name}_t as (select image, class_id, list({{'l': l, 't': t, 'r': r, 'b': b}} order by l, t, r, b) as ts from {truth} group by all),
    {name}_p as (
        select image, class_id, list({{'l': l, 't': t, 'r': r, 'b': b, 'conf': conf, 'taken': []::bigint[], 'hits': []::int[]}} order by conf desc, l, t, r, b) as ps
        from {guess} group by all
    ),
    {name}_s as (
        select bucket, low, high, image, class_id, i, ps, (50 + 5 * i) / 100.0::double as least_overlap, coalesce(ts, []) as ts
        from {name}_p left join {name}_t using (image, class_id), {name}_b, range(10) x(i)
    ),
    {name}_m as materialized (
        select bucket, image, class_id, i, ps, list_reduce(list_concat([{{'l': 0.0, 't': 0.0, 'r': 0.0, 'b': 0.0, 'conf': 0.0, 'taken': []::bigint[], 'hits': []::int[]}}], ps), lambda s, p: list_transform(
            [list_sort(list_filter(list_transform(range(1, len(ts) + 1), lambda j: {{'other': not ({inside('ts[j]')}), 'v': -{inner} / {union}, 'j': j}}), lambda c: c.v <= -least_overlap and not list_contains(s.taken, c.j)))[1]],
            lambda m: {{'l': p.l, 't': p.t, 'r': p.r, 'b': p.b, 'conf': p.conf, 'taken': case when m is null then s.taken else list_append(s.taken, m.j) end,
                       'hits': list_append(s.hits, case when m is null then case when {inside('p')} then 0 else -1 end when m.other then -1 else 1 end)}})[1]).hits as hits
        from {name}_s
    ),
    {name}_e as (select bucket, image, class_id, i, unnest(range(len(ps))) as k, unnest(list_transform(ps, lambda x: x.conf)) as conf, unnest(hits) as hit from {name}_m),
    {name}_n as (select bucket, class_id, count(*) as n_truth from {truth}, {name}_b where (r - l) * (b - t) >= low and (r - l) * (b - t) < high group by all),
    {name}_c as materialized (
        select bucket, class_id, i, n_truth, sum(hit) over w as tp, count(*) over w as seen from {name}_e join {name}_n using (bucket, class_id) where hit >= 0
        window w as (partition by bucket, class_id, i order by conf desc, image, k rows unbounded preceding)
    ),
    {name}_g as (select bucket, class_id, i, cast(100 * tp // n_truth as bigint) as step, max(tp / seen) as p from {name}_c group by all),
    {name}_w as (
        select bucket, class_id, i, max(p) over w as best, step - coalesce(lead(step) over w, -1) as width from {name}_g window w as (partition by bucket, class_id, i order by step desc)
    ),
    {name}_a as (select bucket, class_id, i, sum(best * width) / 101 as ap from {name}_w group by all),
    {name}_f as (select bucket, class_id, max_by({{'p': tp / seen, 'r': tp / n_truth}}, {{'f': 2 * tp / (seen + n_truth), 's': -seen}}) as x from {name}_c where i = 0 group by all),
    {name} as (
        select bucket, class_id, any_value(n_truth) as n_truth, coalesce(sum(ap) filter (i = 0), 0) as ap50, coalesce(sum(ap) / 10, 0) as ap, coalesce(any_value(x.p), 0) as precision, coalesce(any_value(x.r), 0) as recall
        from {name}_n left join {name}_a using (bucket, class_id) left join {name}_f using (bucket, class_id) group by all
    )"""


_MEASURES = ("ap50", "ap", "precision", "recall")
_ROUNDED = ", ".join(f"round({c}, 9) as {c}" for c in _MEASURES)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query(f"with {_boxes_sql(1.5)}, {_precision_sql('found')} select class_id, n_truth, {_ROUNDED} from found")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(detection.average_precision(boxes(spark, sf_dir), findings(spark, sf_dir)).drop("bucket"), *_MEASURES)


@query(f"with {_boxes_sql(1.5)}, {_precision_sql('found')} select count(*) as classes, {', '.join(f'round(avg({c}), 9) as {c}' for c in _MEASURES)}, round(min(ap), 9) as worst_ap from found")
def mean_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detection.average_precision(boxes(spark, sf_dir), findings(spark, sf_dir))
    return _rounded(detection.mean_precision(found), *_MEASURES, "worst_ap")


@query(f"with {_boxes_sql(1.5)}, {_precision_sql('found', spans=detection.SIZES)} select bucket, class_id, n_truth, {_ROUNDED} from found")
def ap_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(detection.precision_by_size(boxes(spark, sf_dir), findings(spark, sf_dir)), *_MEASURES)


_CROWD_PARTS = ", ".join(
    f"""crowd_{name} as (select image from truth group by image having count(*) between {low} and {high}), t_{name} as (from truth semi join crowd_{name} using (image)), g_{name} as (from guess semi join crowd_{name} using (image)),
    {_precision_sql(f'by_{name}', f't_{name}', f'g_{name}')}"""
    for name, low, high in detection.CROWDS
)


@query(f"with {_boxes_sql(1.5)}, {_CROWD_PARTS} " + " union all ".join(f"select '{name}' as bucket, class_id, n_truth, {_ROUNDED} from by_{name}" for name, _, _ in detection.CROWDS))
def ap_by_crowd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(detection.precision_by_crowd(boxes(spark, sf_dir), findings(spark, sf_dir)), *_MEASURES)


@query(
    f"""with {_boxes_sql(1.5)}, {_precision_sql('m_old')}, better as (select * from ({_boxes_sql(0.5).partition('guess as (')[2].strip()[:-1]})), {_precision_sql('m_new', guess='better')},
    pairs as (select m_old.n_truth as n, m_old.ap as a, m_new.ap as z from m_old join m_new using (class_id)),
    moved as (select round(avg(z) - avg(a), 9) as map_delta, round(min(z) - min(a), 9) as worst_delta, round(coalesce(max(a - z) filter (n <= 0.1 * (select sum(n) from pairs)), 0), 9) as minority_loss from pairs)
    select *, map_delta > 0 and worst_delta >= 0 and minority_loss <= 0.05 as passes from moved"""
)
def screening_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second model's boxes are moved by a third of the first one's steps."""
    truths = boxes(spark, sf_dir)
    old, new = (detection.average_precision(truths, findings(spark, sf_dir, step)) for step in (1.5, 0.5))
    return _rounded(detection.screening_passes(old, new), "map_delta", "worst_delta", "minority_loss")


@query(
    f"""with {_boxes_sql(1.5)}, t as (select image, string_agg(class_id, ',' order by l, t, r, b, class_id) as truths from truth group by image),
    p as (select image, string_agg(class_id, ',' order by conf desc, l, t, r, b, class_id) as predictions from guess group by image)
    select o_orderkey as image, coalesce(truths, '') as truths, coalesce(predictions, '') as predictions from orders left join t on t.image = o_orderkey left join p on p.image = o_orderkey"""
)
def boxes_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"))
    held = detection.side_by_side(images, boxes(spark, sf_dir), findings(spark, sf_dir))
    return held.select("image", *(F.array_join(F.transform(c, lambda x: x.class_id), ",").alias(c) for c in ("truths", "predictions")))


def _outlined(name: str, boxes_: str) -> str:
    """{name} (doc_id, n): how many pixels of a document's picture are on the outline of any of its boxes."""
    edge = "(y < trunc(t / 256 * h) + 3 or y > trunc(b / 256 * h) - 3 or x < trunc(l / 256 * 32) + 3 or x > trunc(r / 256 * 32) - 3)"
    inside = "y between trunc(t / 256 * h) and trunc(b / 256 * h) and x between trunc(l / 256 * 32) and trunc(r / 256 * 32)"
    return f"{name} as (select doc_id, count(distinct y * 32 + x) as n from sizes join {boxes_} on image = doc_id, range(32) c(x), range(h) d(y) where {inside} and {edge} group by doc_id)"


@query(
    f"""with {_boxes_sql(1.5)}, sizes as (select doc_id, (octet_length(encode(text)) + 95) // 96 as h from documents where length(text) > 0), {_outlined('blue', 'truth')}, {_outlined('red', 'guess')}
    select doc_id as image, 64 as width, cast(h + 24 as int) as height, coalesce(blue.n, 0) as blue, coalesce(red.n, 0) as red from sizes left join blue using (doc_id) left join red using (doc_id)"""
)
def pair_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pictures beside themselves, with order lines of the same number as boxes; the files are read back, and the pixels in each colour counted."""
    docs = table(spark, sf_dir, "documents").where("length(text) > 0").select(F.col("doc_id").alias("image"), F.encode("text", "UTF-8").alias("bytes"))
    rows = F.ceil(F.octet_length("bytes") / 96).cast("int")
    full = F.unhex(F.rpad(F.hex("bytes"), rows * 192, F.lit("0")))
    held = docs.select("image", F.lit(32).alias("width"), rows.alias("height"), full.alias("data"))
    shares = lambda df: df.withColumns({c: F.col(c) / 256 for c in detection.CORNERS})
    files = pictures.as_png(pictures.pairs(held, shares(boxes(spark, sf_dir)), shares(findings(spark, sf_dir))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.column("png"):  # one picture's pixels at a time
                p = canvas.pixels(x.as_py())
                found.append([int((p == colour).all(2).sum()) for colour in (canvas.TRUTH, canvas.FOUND)])
            blue, red = (pa.array([n[k] for n in found], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("image", "width", "height")), blue, red], ["image", "width", "height", "blue", "red"])

    return files.mapInArrow(count, "image long, width int, height int, blue long, red long")
