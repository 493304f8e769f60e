"""All queries of the audit engine over the test tables, each with the SQL that it must agree with.

Tables stand in for a dataset: documents are images (text as content, source as annotation), orders are images and their lines boxes, events are
predictions (click) and truths (view), embeddings are feature vectors. A key's last digit gives its split: below 7 train, 7 val, else test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import hashes, raster
from plumbline.operators import adapter, audit, labels, reports, split
from plumbline.operators.ordering import global_index, path_order
from plumbline.sources.scratch import materialize

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(key: str) -> Column:
    return F.expr(f"case when {key} % 10 < 7 then 'train' when {key} % 10 = 7 then 'val' else 'test' end")


def _split_sql(key: str) -> str:
    return f"case when {key} % 10 < 7 then 'train' when {key} % 10 = 7 then 'val' else 'test' end"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as image records."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.col("doc_id").alias("record_idx"), split_of("doc_id").alias("split"), F.sha2("text", 256).alias("sha256"), F.expr("left(text, 24)").alias("parent_id"), F.expr("right(text, 24)").alias("tail_id"), "source")


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(audit.components(materialize(records(spark, sf_dir), "records"), ["sha256", "parent_id", "tail_id"]), "components")


_RECORDS = f"select doc_id, sha256(text) as sha256, left(text, 24) as p, right(text, 24) as t, source, {_split_sql('doc_id')} as split from documents"
#: Labels spread along the first record of each key until nothing changes.
_COMPONENTS = f"""
    with recursive recs as ({_RECORDS}),
    edges as (
        select doc_id as a, min(doc_id) over (partition by p) as b from recs
        union select doc_id, min(doc_id) over (partition by t) from recs
        union select doc_id, min(doc_id) over (partition by sha256) from recs
    ),
    both_ways as (select a, b from edges where a <> b union select b, a from edges where a <> b),
    reach as (select doc_id as node, doc_id as seen from recs union select r.node, e.b from reach r join both_ways e on r.seen = e.a),
    comp as (select node as doc_id, min(seen) as component_id from reach group by node)
"""


@query(_COMPONENTS + "select c.doc_id, c.component_id, r.split from comp c join recs r on r.doc_id = c.doc_id")
def leakage_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(spark, sf_dir).select("doc_id", "component_id", "split")


@query(
    _COMPONENTS
    + """select c.component_id, count(*) as n_records, string_agg(distinct r.split, ',' order by r.split) as splits
    from comp c join recs r on r.doc_id = c.doc_id group by c.component_id having count(distinct r.split) > 1"""
)
def cross_split_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.cross_split(grouped(spark, sf_dir))


@query(_COMPONENTS + "select count(*) as duplicate_components from (select component_id from comp group by component_id having count(*) > 1)")
def duplicate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_components(grouped(spark, sf_dir))


@query("select l_orderkey as image, cast(to_json(list_sort(list({'class_id': l_returnflag, 'part': l_partkey}))) as varchar) as signature from lineitem group by l_orderkey")
def annotation_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.struct(F.col("l_returnflag").alias("class_id"), F.col("l_partkey").alias("part"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image")).agg(labels.signature(box).alias("signature"))


@query("select cast(coalesce(sum(n - 1), 0) as bigint) as pairs from (select count(*) as n from documents group by text)")
def exact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_pairs(records(spark, sf_dir), "sha256")


@query("select cast(coalesce(sum(n - 1), 0) as bigint) as pairs from (select count(*) as n from documents group by left(text, 24))")
def parent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_pairs(records(spark, sf_dir), "parent_id")


@query("select sha256(text) as key, count(*) as n_records, count(distinct source) as n_signatures from documents group by 1 having count(distinct source) > 1")
def annotation_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.conflicts(records(spark, sf_dir), "sha256", "source")


@query(
    _COMPONENTS
    + """, crossing as (select component_id from comp c join recs r on r.doc_id = c.doc_id group by 1 having count(distinct r.split) > 1),
    conflicting as (select sha256 from recs group by 1 having count(distinct source) > 1)
    select (select count(*) from documents where text is null) as n_errors, (select count(*) from crossing) as n_cross_split,
           (select count(*) from conflicting) as n_conflicts,
           (select count(*) from documents where text is null) + (select count(*) from crossing) + (select count(*) from conflicting) = 0 as safe"""
)
def audit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = grouped(spark, sf_dir)
    return audit.gate(held.where("sha256 is null"), audit.cross_split(held), audit.conflicts(held, "sha256", "source"))


@query(
    _COMPONENTS
    + """, crossing as (select component_id, count(*) as n_records, string_agg(distinct split, ',' order by split) as splits from comp join recs using (doc_id) group by 1 having count(distinct split) > 1 order by 1 limit 50),
    files as (select component_id, array_to_string(list('img/' || doc_id || '.jpg' order by doc_id)[1:3], ',') as files from comp group by 1)
    select component_id, n_records, splits, files from crossing join files using (component_id)"""
)
def cross_split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = grouped(spark, sf_dir).withColumn("image_path", F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit(".jpg")))
    return audit.cross_split_files(held, files=3).withColumn("files", F.array_join("files", ","))


@query(
    """with g as (select sha256(text) as sha256, min(doc_id) as first, count(*) as n_records, array_to_string(list('txt/' || doc_id || '.txt' order by doc_id)[1:4], ',') as files from documents group by 1 having count(distinct source) > 1)
    select sha256, first, n_records, files from g order by first limit 50"""
)
def conflict_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = records(spark, sf_dir).withColumn("label_path", F.concat(F.lit("txt/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return audit.conflict_files(held, "sha256", "source", files=4).withColumn("files", F.array_join("files", ","))


def orders_as_images(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), split_of("o_orderkey").alias("split"))
    boxes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_returnflag").alias("class_id"))
    return images, boxes


_BY_SPLIT = f"""
    select split, count(*) as n_images, cast(sum(n) as bigint) as n_boxes, count(*) filter (n = 0) as n_empty
    from (select o_orderkey, {_split_sql('o_orderkey')} as split, count(l_orderkey) as n from orders left join lineitem on o_orderkey = l_orderkey group by 1) group by split
"""


@query(f"select split, n_images from ({_BY_SPLIT})")
def images_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.by_split(*orders_as_images(spark, sf_dir), "image").select("split", "n_images")


@query(f"select split, n_boxes from ({_BY_SPLIT})")
def boxes_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.by_split(*orders_as_images(spark, sf_dir), "image").select("split", "n_boxes")


@query(f"select split, n_empty from ({_BY_SPLIT}) where n_empty > 0")
def empty_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.by_split(*orders_as_images(spark, sf_dir), "image").where("n_empty > 0").select("split", "n_empty")


def flags(spark: SparkSession) -> DataFrame:
    """The class domain, with one class that no box has."""
    return spark.createDataFrame([("A",), ("N",), ("R",), ("Z",)], "class_id string")


_FLAGS = "(values ('A'), ('N'), ('R'), ('Z')) c(class_id)"


@query(f"select class_id, count(l_orderkey) as n_boxes from {_FLAGS} left join lineitem on l_returnflag = class_id group by 1")
def boxes_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.by_class(orders_as_images(spark, sf_dir)[1], flags(spark), "image").select("class_id", "n_boxes")


@query(f"select class_id, count(distinct l_orderkey) as n_images from {_FLAGS} left join lineitem on l_returnflag = class_id group by 1")
def images_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.by_class(orders_as_images(spark, sf_dir)[1], flags(spark), "image").select("class_id", "n_images")


@query(
    f"""select doc_id, row_number() over (order by array_position(['train', 'val', 'test'], split), string_split(path, '/'), doc_id) - 1 as record_idx
    from (select doc_id, {_split_sql('doc_id')} as split, source || '/' || lang || '-' || (doc_id % 97) as path from documents)"""
)
def record_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "documents").select("doc_id", split_of("doc_id").alias("split"), F.concat("source", F.lit("/"), "lang", F.lit("-"), (F.col("doc_id") % 97).cast("string")).alias("path"))
    return global_index(paths, split.split_rank(), path_order("path"), "doc_id", name="record_idx").select("doc_id", "record_idx")


@query(_COMPONENTS + "select component_id, dense_rank() over (order by component_id) - 1 as group_idx, 'group-' || lpad(cast(dense_rank() over (order by component_id) - 1 as varchar), 6, '0') as group_id from comp group by component_id")
def group_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.number_groups(grouped(spark, sf_dir))


#: A label line for each row: mostly boxes, some polygons, and each kind of error.
_LINE = """
    case when l_linenumber = 7 and l_quantity > 45 then concat('x', ' 0.5 0.5 0.1 0.1')
         when l_linenumber = 6 and l_quantity > 45 then '0 0.1 0.2 0.3'
         when l_linenumber = 5 and l_quantity > 47 then '0 0.5 nan 0.1 0.1'
         when l_linenumber = 5 and l_quantity > 45 then '0 0.5 0.5 0 0.1'
         when l_linenumber = 4 and l_quantity > 40 then concat('0 0.1 0.1 0.', cast(cast(l_quantity as int) as {text}), ' 0.1 0.3 0.5')
         when l_linenumber = 3 and l_quantity > 48 then '1_0 .5 5e-1 +0.1 0.1'
         when l_linenumber = 2 and l_quantity > 48 then '1 0.5 0.5 1f 0.1'
         else concat(cast(l_linenumber - 1 as {text}), '  0.', cast(cast(l_quantity as int) as {text}), ' 0.', cast(cast(l_quantity as int) as {text}), '0 0.2', ' ', cast(cast(l_extendedprice / 50000 as int) as {text}), '.25')
    end
"""


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("part"), F.expr(_LINE.format(text="string").replace("/ 50000 as int", "/ 50000 as bigint")).alias("line"))


def parsed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = spark.createDataFrame([(0,), (1,), (2,), (3,), (4,), (5,)], "class_id int")
    return labels.parse_lines(label_lines(spark, sf_dir), classes)


_INT, _NUM = r"^[+-]?[0-9](_?[0-9])*$", r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(inf|infinity|nan)$"
_PARSED = f"""
    with lines as (select l_orderkey as image, l_linenumber as line_no, l_partkey as part, {_LINE.format(text='varchar').replace('cast(l_quantity as int)', 'cast(trunc(l_quantity) as int)').replace('cast(l_extendedprice / 50000 as int)', 'cast(trunc(l_extendedprice / 50000) as bigint)')} as line from lineitem),
    tokens as (select *, string_split_regex(trim(line), '\\s+') as t from lines),
    numbers as (
        select *, regexp_matches(t[1], '{_INT}') and len(list_filter(t[2:], lambda s: not regexp_matches(lower(s), '{_NUM}'))) = 0 as ok,
               try_cast(replace(t[1], '_', '') as bigint) as c, list_transform(t[2:], lambda s: try_cast(s as double)) as v from tokens
    ),
    shaped as (
        select *, len(v) as n, list_filter(v, lambda x, i: i % 2 = 1) as xs, list_filter(v, lambda x, i: i % 2 = 0) as ys from numbers
    ),
    boxes as (
        select *, case when n = 4 then v[1] else (list_min(xs) + list_max(xs)) / 2 end as x, case when n = 4 then v[2] else (list_min(ys) + list_max(ys)) / 2 end as y,
               case when n = 4 then v[3] else list_max(xs) - list_min(xs) end as w, case when n = 4 then v[4] else list_max(ys) - list_min(ys) end as h from shaped
    ),
    judged as (
        select *, case when not ok then 'not_numeric' when c not between 0 and 5 then 'class' when n <> 4 and (n < 6 or n % 2 = 1) then 'polygon'
                       when len(list_filter(v, lambda s: isnan(s) or isinf(s))) > 0 then 'non_finite'
                       when not (x between 0 and 1 and y between 0 and 1 and w between 0 and 1 and h between 0 and 1) then 'range'
                       when w <= 0 or h <= 0 then 'empty_box' end as error from boxes
    ),
    firsts as (select image, error, line_no, part, row_number() over (partition by image order by line_no, part) as k from judged where error is not null)
"""


@query(
    _PARSED
    + """select image, cast(line_no as int) as line_no, part, cast(c as int) as class_id, round(x, 6) as x_center, round(y, 6) as y_center, round(w, 6) as width, round(h, 6) as height
    from judged where image not in (select image from firsts)"""
)
def label_parse_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = labels.valid_boxes(materialize(parsed_labels(spark, sf_dir), "parsed"), "image")
    return kept.select("image", "line_no", "part", "class_id", *(F.round(c, 6).alias(c) for c in ("x_center", "y_center", "width", "height")))


@query(_PARSED + "select image, min(line_no) as line_no, count(*) as n_errors from judged where error is not null group by image")
def label_parse_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.quarantine(parsed_labels(spark, sf_dir), "image", count=True).select("image", "line_no", "n_errors")


@query(_PARSED + "select error, count(*) as n from judged where error is not null group by error")
def label_parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_labels(spark, sf_dir).where("error is not null").groupBy("error").agg(F.count("*").alias("n"))


@query(
    """select vec_id, round((list_min(xs) + list_max(xs)) / 2, 5) as x_center, round((list_min(ys) + list_max(ys)) / 2, 5) as y_center,
              round(list_max(xs) - list_min(xs), 5) as width, round(list_max(ys) - list_min(ys), 5) as height
    from (select vec_id, list_filter(e, lambda x, i: i % 2 = 1) as xs, list_filter(e, lambda x, i: i % 2 = 0) as ys from (select vec_id, cast(embedding as double[]) as e from embeddings))"""
)
def polygon_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", labels.outline(F.col("embedding").cast("array<double>")).alias("box"))
    names = {"x": "x_center", "y": "y_center", "w": "width", "h": "height"}
    return e.select("vec_id", *(F.round(f"box.{k}", 5).alias(n) for k, n in names.items()))


#: Polygons of three or four points, in some of which a number is NaN or infinite, at the first place or a later one.
_POLYGON = """
    concat(cast(l_linenumber - 1 as {text}), {numbers}, case when l_quantity > 25 then concat(' 0.9', cast(l_linenumber as {text}), ' 0.05') else '' end)
"""
_NUMBERS = ", ".join(f"case when (l_suppkey + {i}) % 17 = 0 then ' nan' when (l_suppkey + {i}) % 61 = 0 then ' -inf' else concat(' 0.', cast(10 + (l_partkey * {i + 3}) % 89 as {{text}})) end" for i in range(6))


@query(
    f"""with lines as (select l_orderkey as image, l_linenumber as line_no, l_partkey as part, l_suppkey as supplier, {_POLYGON.format(numbers=_NUMBERS, text='varchar').format(text='varchar')} as line from lineitem),
    v as (select *, list_transform(string_split(line, ' ')[2:], lambda s: cast(s as double)) as v from lines),
    p as (select *, list_filter(v, lambda x, i: i % 2 = 1) as xs, list_filter(v, lambda x, i: i % 2 = 0) as ys from v),
    e as (select *, list_reduce(xs, lambda m, x: case when not isnan(m) and x < m then x else m end) as l, list_reduce(xs, lambda m, x: case when not isnan(x) and x > m then x else m end) as r,
                 list_reduce(ys, lambda m, x: case when not isnan(m) and x < m then x else m end) as t, list_reduce(ys, lambda m, x: case when not isnan(x) and x > m then x else m end) as b from p),
    boxes as (select *, (l + r) / 2 as x, (t + b) / 2 as y, r - l as w, b - t as h from e),
    judged as (select *, case when line_no > 6 then 'class' when not (isfinite(x) and isfinite(y) and isfinite(w) and isfinite(h)) then 'non_finite'
                              when not (x between 0 and 1 and y between 0 and 1 and w between 0 and 1 and h between 0 and 1) then 'range' when w <= 0 or h <= 0 then 'empty_box' end as error from boxes)
    select image, line_no, part, supplier, error, case when error is null then round(x, 6) end as x_center, case when error is null then round(y, 6) end as y_center,
           case when error is null then round(w, 6) end as width, case when error is null then round(h, 6) end as height from judged"""
)
def label_parse_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr(_POLYGON.format(numbers=_NUMBERS, text="string").format(text="string"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), line.alias("line"))
    classes = spark.createDataFrame([(0,), (1,), (2,), (3,), (4,), (5,)], "class_id int")
    return labels.parse_lines(lines, classes).select("image", "line_no", "part", "supplier", "error", *(F.round(c, 6).alias(c) for c in ("x_center", "y_center", "width", "height")))


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    colour = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double") * 40)
    return e.select(F.col("vec_id").alias("record_idx"), hashes.difference_bits("embedding").alias("dhash"), colour.alias("mean_rgb"))


_DHASH = "select vec_id, list_reduce(list_transform(range(1, len(embedding)), lambda i: case when embedding[i + 1] > embedding[i] then 1::bigint else 0::bigint end), lambda s, b: s * 2 + b) as dhash, list_transform(embedding[1:3], lambda x: cast(x as double) * 40) as rgb from embeddings"
_BANDS = f"select vec_id, unnest(range(8)) as band, (dhash >> (8 * unnest(range(8)))) & 255 as value from ({_DHASH})"


@query(f"select vec_id, dhash from ({_DHASH})")
def dhash_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(spark, sf_dir).select(F.col("record_idx").alias("vec_id"), "dhash")


@query(f"select vec_id, cast(band as bigint) as band, cast(value as bigint) as value from ({_BANDS})")
def hash_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = hashed(spark, sf_dir).select(F.col("record_idx").alias("vec_id"), F.posexplode(hashes.bands("dhash")).alias("band", "value"))
    return each.select("vec_id", F.col("band").cast("long").alias("band"), F.col("value").cast("long").alias("value"))


_NEAR = f"""
    with h as ({_DHASH}), b as ({_BANDS})
    select distinct x.vec_id as a, y.vec_id as b from b p join b q on p.band = q.band and p.value = q.value and p.vec_id < q.vec_id
    join h x on x.vec_id = p.vec_id join h y on y.vec_id = q.vec_id where bit_count(xor(x.dhash, y.dhash)) <= 16
"""


@query(_NEAR)
def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.near_pairs(hashed(spark, sf_dir), 16, colour=None)


@query(_NEAR + " and greatest(abs(x.rgb[1] - y.rgb[1]), abs(x.rgb[2] - y.rgb[2]), abs(x.rgb[3] - y.rgb[3])) <= 12.0")
def near_pairs_by_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.near_pairs(hashed(spark, sf_dir), 16)


@query(f"select count(*) as near_pairs from ({_NEAR})")
def near_pair_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.near_pair_count(hashed(spark, sf_dir), 16, colour=None)


_GRID = "list_transform(range(72), lambda i: unicode(text[1 + i * length(text) // 72])) as g"
_GRIDS = f"select doc_id, list_reduce(list_concat([0::bigint], list_transform(list_filter(range(1, 72), lambda i: i % 9 <> 0), lambda i: case when g[i + 1] > g[i] then 1::bigint else 0::bigint end)), lambda s, b: (s << 1) | b) as dhash from (select doc_id, {_GRID} from documents where length(text) > 0)"


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as grey rasters of nine columns and eight rows: characters at even distances over the whole text; texts without any have none."""
    docs = table(spark, sf_dir, "documents").where("length(text) > 0")
    sample = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.ascii(F.substr("text", (F.lit(1) + F.floor(i * F.length("text") / 72)).cast("int"), F.lit(1))))
    hashed_once = F.transform(F.array(sample), lambda g: hashes.grid_difference_hash(g))[0]  # of one element, so that a grid isn't sampled again for each of its places
    return docs.select(F.col("doc_id").alias("record_idx"), hashed_once.alias("dhash"))


@query(_GRIDS.replace("(s << 1) | b", "case when s >= 4611686018427387904 then (s - 4611686018427387904) * 2 + b + (-9223372036854775807 - 1) else s * 2 + b end"))
def grid_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids(spark, sf_dir).withColumnRenamed("record_idx", "doc_id")


@query(f"""with h as ({_GRIDS.replace("(s << 1) | b", "case when s >= 4611686018427387904 then (s - 4611686018427387904) * 2 + b + (-9223372036854775807 - 1) else s * 2 + b end")})
    select x.doc_id as a, y.doc_id as b from h x join h y on x.doc_id < y.doc_id and bit_count(xor(x.dhash, y.dhash)) <= 4""")
def near_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.near_pairs(materialize(grids(spark, sf_dir), "grids"), 4, colour=None)


PIXELS = 32  # of a row, when a text's bytes are a picture


def _weights_sql(name: str, sizes: str, to: int, kernel: str, reach: int) -> str:
    """{name} (n, o, x, w): the whole-number weights that resample n places, of the sizes that a query gives, to a fixed number."""
    return f"""
    {name}_k as (
        select n, o, x, case when abs(away) < {reach} * wide then {kernel} else 0 end as k from (
        select *, away / wide as u from (select n, o, x, greatest(n / {to}::double, 1) as wide, x + 0.5::double - (o + 0.5::double) * (n / {to}::double) as away from ({sizes}), range({to}) a(o), range(n) b(x)))
    ),
    {name} as (select n, o, x, cast(sign(k) * floor(abs(k / sum(k) over (partition by n, o)) * 4194304 + 0.5::double) as bigint) as w from {name}_k)"""


_LANCZOS = "case when u = 0 then 1 else sin(pi() * u) / (pi() * u) * sin(pi() * u / 3) / (pi() * u / 3) end"
_BYTE = "least(255, greatest(0, cast(floor((sum(v * w) + 2097152) / 4194304.0::double) as bigint)))"
_RASTERS = f"""
    b as (select doc_id, regexp_extract_all(hex(encode(text)), '..') as hs from documents where length(text) > 0),
    s as (select doc_id, (len(hs) + {3 * PIXELS - 1}) // {3 * PIXELS} as h, hs from b),
    f as (select doc_id, h, unnest(range(h * {3 * PIXELS})) as i, unnest(list_transform(range(1, h * {3 * PIXELS} + 1), lambda j: case when j > len(hs) then 0 else ('0x' || hs[j])::int end)) as v from s),
    p as (select doc_id, h, i // {3 * PIXELS} as y, i // 3 % {PIXELS} as x, i % 3 as c, v from f),
    {_weights_sql('wx', f'select {PIXELS} as n', 9, _LANCZOS, 3)}, {_weights_sql('wy', 'select distinct h as n from s', 8, _LANCZOS, 3)}, {_weights_sql('wt', 'select distinct h as n from s', 32, 'greatest(0, 1 - abs(u))', 1)},
    g as (select doc_id, h, y, x, (19595 * sum(v) filter (c = 0) + 38470 * sum(v) filter (c = 1) + 7471 * sum(v) filter (c = 2) + 32768) // 65536 as v from p group by all),
    ga as (select doc_id, h, y, o as j, {_BYTE} as v from g join wx using (x) group by all),
    gd as (select doc_id, wy.o as i, j, {_BYTE} as v from ga join wy on wy.n = h and wy.x = y group by all),
    bits as (select doc_id, list(case when z.v > a.v then 1::bigint else 0::bigint end order by a.i, a.j) as l from gd a join gd z using (doc_id) where z.i = a.i and z.j = a.j + 1 group by doc_id),
    hashed as (select doc_id, list_reduce(l, lambda s, b: case when s >= 4611686018427387904 then (s - 4611686018427387904) * 2 + b + (-9223372036854775807 - 1) else s * 2 + b end) as dhash from bits),
    m as (select doc_id, c, p.x as x, o, {_BYTE} as v from p join wt on wt.n = h and wt.x = y group by all),
    means as (select doc_id, avg(v) filter (c = 0) as red, avg(v) filter (c = 1) as green, avg(v) filter (c = 2) as blue from m group by doc_id)
"""


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pictures: their bytes as red, green and blue, ``PIXELS`` pixels a row."""
    return raster.sample_features(table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data")), "data", PIXELS).where("dhash is not null")


@query(f"with {_RASTERS} select doc_id, dhash, round(red, 6) as red, round(green, 6) as green, round(blue, 6) as blue from hashed join means using (doc_id)")
def raster_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters(spark, sf_dir).select("doc_id", "dhash", *(F.round(F.col("mean_rgb")[i], 6).alias(c) for i, c in enumerate(("red", "green", "blue"))))


@query(
    f"""with {_RASTERS}, r as (select doc_id, dhash, red, green, blue from hashed join means using (doc_id))
    select x.doc_id as a, y.doc_id as b from r x join r y on x.doc_id < y.doc_id and bit_count(xor(x.dhash, y.dhash)) <= 4 where greatest(abs(x.red - y.red), abs(x.green - y.green), abs(x.blue - y.blue)) <= 12.0"""
)
def near_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.near_pairs(materialize(rasters(spark, sf_dir).withColumnRenamed("doc_id", "record_idx").drop("data"), "rasters"), 4)


def customers_as_groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders in groups of one customer's, and their boxes."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_idx"), F.col("o_custkey").alias("component_id"))
    boxes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_idx"), F.col("l_returnflag").alias("class_id"))
    return orders, boxes


_COUNTS = "select o_custkey as component_id, l_returnflag as class_id, count(*) as n from orders join lineitem on o_orderkey = l_orderkey group by 1, 2"


@query(_COUNTS)
def class_counts_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.class_counts(*customers_as_groups(spark, sf_dir))


@query(
    f"""with counts as ({_COUNTS}), totals as (select class_id, sum(n) as total from counts group by 1),
    rare as (select component_id, max(n / greatest(total, 1)) as rarity from counts join totals using (class_id) group by 1),
    sizes as (select o_custkey as component_id, count(*) as size from orders group by 1)
    select component_id, size, round(coalesce(rarity, 0), 9) as rarity, row_number() over (order by coalesce(rarity, 0) desc, size desc, component_id) - 1 as place
    from sizes left join rare using (component_id)"""
)
def rarity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, boxes = customers_as_groups(spark, sf_dir)
    sizes = orders.groupBy("component_id").agg(F.count("*").alias("size"))
    ranked = split.rarity(sizes, split.class_counts(orders, boxes))
    return global_index(ranked, F.desc("rarity"), F.desc("size"), "component_id", name="place").select("component_id", "size", F.round("rarity", 9).alias("rarity"), "place")


@query()
def greedy_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, boxes = customers_as_groups(spark, sf_dir)
    return split.assign(orders, materialize(split.class_counts(orders, boxes), "class-counts"), seed=42, classes=["A", "N", "R", "Z"])


@query(f"select min(doc_id) as doc_id, text_sha as sha256 from (select doc_id, sha256(text) as text_sha, {_split_sql('doc_id')} as split, row_number() over (partition by text order by array_position(['train', 'val', 'test'], {_split_sql('doc_id')}), doc_id) as k from documents) where k = 1 group by text_sha")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.keep_first(records(spark, sf_dir), "sha256", split.split_rank(), F.col("doc_id")).select("doc_id", "sha256")


@query(
    f"""select doc_id, split, case when k = 1 then stem else stem || '-' || (k - 1) end as name from (
    select doc_id, split, stem, row_number() over (partition by split, stem order by doc_id) as k from (
    select doc_id, {_split_sql('doc_id')} as split, source || '_' || lang as stem from documents))"""
)
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "documents").select("doc_id", split_of("doc_id").alias("split"), F.concat("source", F.lit("_"), "lang").alias("stem"), F.lit(".jpg").alias("suffix"))
    return split.output_names(named, F.col("doc_id")).select("doc_id", "split", "name")


@query()
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = grouped(spark, sf_dir)
    boxes = held.select("record_idx", F.col("source").alias("class_id"))
    assigned = materialize(split.assign(held, materialize(split.class_counts(held, boxes), "class-counts"), seed=42), "assigned")
    images = held.withColumns({"image_path": F.concat(F.lit("img/"), "source", F.lit("_"), F.pmod(F.xxhash64("doc_id"), F.lit(5000)).cast("string"), F.lit(".jpg")), "suffix": F.lit(".jpg")})
    images = images.withColumn("stem", F.regexp_extract("image_path", r"([^/]+)\.jpg$", 1))
    return split.manifest(images, assigned)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "image")
    images = events.select("image").distinct()
    return reports.count_errors(images, events.where("event_type = 'view'"), events.where("event_type = 'click'").withColumnRenamed("value", "conf"))


_ERRORS = """
    select user_id as image, count(*) filter (event_type = 'view') as truth, count(*) filter (event_type = 'click') as predicted,
           abs(count(*) filter (event_type = 'click') - count(*) filter (event_type = 'view')) as error,
           coalesce(min(value) filter (event_type = 'click'), 0.0) as min_conf, coalesce(avg(value) filter (event_type = 'click'), 0.0) as mean_conf
    from events group by user_id
"""


@query(f"select image, truth, predicted, error, round(min_conf, 6) as min_conf, round(mean_conf, 6) as mean_conf from ({_ERRORS})")
def count_error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rows(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("min_conf", "mean_conf")})


@query(
    f"""select count(*) as images, cast(sum(truth) as bigint) as truth, cast(sum(predicted) as bigint) as predicted, count(*) filter (error = 0) as exact,
    round(avg(error), 6) as mae, round(count(*) filter (error = 0) / count(*), 6) as exact_rate, count(*) filter (error > 0) as wrong from ({_ERRORS})"""
)
def count_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.count_summary(event_rows(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mae", "exact_rate")})


@query(f"select image, error, round(min_conf, 6) as min_conf from ({_ERRORS}) order by error desc, {'min_conf'}, image limit 12")
def hard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.hardest(event_rows(spark, sf_dir), 12).select("image", "error", F.round("min_conf", 6).alias("min_conf"))


@query()
def audit_sample_zero_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.select_for_audit(event_rows(spark, sf_dir).withColumn("error", F.lit(0).cast("long")), 12, seed=42)


_BOX = "select vec_id, 0.5 + embedding[1] / 10.0 as x, 0.5 + embedding[2] / 10.0 as y, 0.1 + abs(embedding[3]) / 10.0 as w, 0.1 + abs(embedding[4]) / 10.0 as h, 100 + vec_id % 900 as iw, 80 + vec_id % 700 as ih from (select vec_id, cast(embedding as double[]) as embedding from embeddings)"


def boxes_of_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", (0.5 + e(0) / 10.0).alias("x_center"), (0.5 + e(1) / 10.0).alias("y_center"), (0.1 + F.abs(e(2)) / 10.0).alias("width"), (0.1 + F.abs(e(3)) / 10.0).alias("height"), (100 + F.col("vec_id") % 900).alias("image_width"), (80 + F.col("vec_id") % 700).alias("image_height"))


@query(f'select vec_id, round((x - w / 2) * iw, 6) as "left", round((y - h / 2) * ih, 6) as top, round((x + w / 2) * iw, 6) as "right", round((y + h / 2) * ih, 6) as bottom, round(greatest(0.0, (y - h / 2) * ih - 11), 6) as text_y from ({_BOX})')
def box_to_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.to_pixels(boxes_of_vectors(spark, sf_dir)).select("vec_id", *(F.round(c, 6).alias(c) for c in ("left", "top", "right", "bottom", "text_y")))


@query(
    f"""with p as (select rank, greatest(1, cast(round_even(ih * (900.0::double / iw), 0) as int)) as height, rank // 2 as line from (select *, row_number() over (order by ih desc, vec_id) - 1 as rank from ({_BOX})) where rank < 24),
    l as (select line, max(height) as h from p group by line)
    select rank, (rank % 2) * 900 as x, cast(coalesce((select sum(h) from l where l.line < p.line), 0) as bigint) as y, 900 as width, height, (select cast(sum(h) as bigint) from l) as sheet_height from p"""
)
def contact_sheet_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    tallest = boxes_of_vectors(spark, sf_dir).orderBy(F.desc("image_height"), "vec_id").limit(24)
    rank = F.row_number().over(Window.orderBy(F.desc("image_height"), "vec_id")) - 1  # of the sheet's pictures alone
    return reports.contact_sheet(tallest.withColumn("rank", rank.cast("long")))


@query("select vec_id, 'c' || (vec_id % 6) || ' ' || printf('%.2f', cast(abs(embedding[5]) as double)) as caption from embeddings")
def box_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("c"), (F.col("vec_id") % 6).cast("string"))
    return table(spark, sf_dir, "embeddings").select("vec_id", reports.caption(name, F.abs(F.col("embedding")[4])).alias("caption"))


@query(f"select rank, printf('%02d_user.%s.jpg', rank, cast(image as varchar)) as name from (select image, row_number() over (order by error desc, min_conf, image) as rank from ({_ERRORS})) where rank <= 120")
def pair_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = reports.hardest(event_rows(spark, sf_dir), 120)
    rank = F.row_number().over(Window.orderBy(*reports.hard_order())).cast("long")  # of the pictures that are picked alone
    return hard.select(rank.alias("rank"), reports.pair_name(rank, F.concat(F.lit("/test/user."), F.col("image").cast("string"), F.lit(".png"))).alias("name"))


def flag_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models' metrics, in order: those of each return flag."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("code"))
    wide = lines.agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"), F.avg("l_quantity").alias("c"), F.min("l_extendedprice").alias("d"))
    names = ("metrics/mAP50-95(B)", "metrics/mAP50(B)", "metrics/precision(B)", "worst_class_map50_95")
    each = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("key"), F.col(c).alias("value")) for i, (n, c) in enumerate(zip(names, "abcd", strict=True))))
    return wide.select("code", F.explode(each).alias("m")).select("code", "m.*")


_FLAG_METRICS = "select l_returnflag as code, avg(l_discount) as a, avg(l_tax) as b, avg(l_quantity) as c, min(l_extendedprice) as d from lineitem group by 1"
_LONG = f"""
    with w as ({_FLAG_METRICS}), m as (
    select code, 'map50-95' as metric, a as v from w union all select code, 'map50', b from w union all select code, 'precision', c from w union all select code, 'worst_class_map50_95', d from w)
"""


@query(_LONG + "select x.metric, round(x.v, 9) as baseline, round(y.v, 9) as candidate, round(y.v - x.v, 9) as delta from m x join m y on x.metric = y.metric where x.code = 'A' and y.code = 'R'")
def screening_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta = reports.model_delta(materialize(flag_metrics(spark, sf_dir), "metrics"), "A", "R")
    return delta.select("metric", *(F.round(c, 9).alias(c) for c in ("baseline", "candidate", "delta")))


@query(f"select code, round(b, 9) as value from ({_FLAG_METRICS})")
def metric_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.find_metric(flag_metrics(spark, sf_dir), "mAP50", "code").withColumn("value", F.round("value", 9))


@query(
    """with v as (select l_linestatus as code, cast(ascii(l_returnflag) - 65 as bigint) as class_id, avg(l_discount) as value from lineitem group by 1, 2)
    select code, round(min(value), 9) as value from v where class_id in (0, 13, 17) group by code"""
)
def per_class_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("code"), (F.ascii("l_returnflag") - 65).alias("k")).agg(F.avg("l_discount").alias("v"))
    arrays = v.groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m")).select("code", F.transform(F.sequence(F.lit(0), F.lit(25)), lambda i: F.element_at("m", i)).alias("values"))
    classes = spark.createDataFrame([(0, "A"), (13, "N"), (17, "R"), (30, "none")], "class_id int, name string")
    return reports.worst_class(reports.per_class(arrays, classes), "code").withColumn("value", F.round("value", 9))


def adapter_weights(rank: int = 4, channels: int = 64) -> tuple[list, list, list]:
    """Fixed small weights by rule."""
    left = [[((3 * r + c) % 7 - 3) / 10 for c in range(channels)] for r in range(rank)]
    right = [[((5 * r + 2 * c) % 11 - 5) / 10 for c in range(channels)] for r in range(rank)]
    return left, right, [[((c + 2 * r) % 5 - 2) / 10 for r in range(rank)] for c in range(channels)]


@query(
    """with e as (select vec_id, cast(embedding as double[]) as x from embeddings),
    p as (select vec_id, x, list_transform(range(4), lambda r: list_sum(list_transform(range(64), lambda c: ((3 * r + c) % 7 - 3) / 10.0 * x[c + 1])) * list_sum(list_transform(range(64), lambda c: ((5 * r + 2 * c) % 11 - 5) / 10.0 * x[c + 1]))) as z from e),
    q as (select vec_id, x, list_transform(z, lambda v: sign(v) * sqrt(abs(v) + 1e-6)) as z from p),
    u as (select vec_id, x, list_transform(z, lambda v: v / greatest(sqrt(list_sum(list_transform(z, lambda w: w * w))), 1e-6)) as z from q),
    y as (select vec_id, list_transform(range(64), lambda c: x[c + 1] + 0.5 * list_sum(list_transform(range(4), lambda r: ((c + 2 * r) % 5 - 2) / 10.0 * z[r + 1]))) as y from u)
    select vec_id, unnest(range(64)) as channel, round(unnest(y), 5) + 0.0 as value from y"""
)
def bilinear_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = adapter.bilinear_adapter("embedding", *adapter_weights(), scale=0.5)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(out).alias("c", "v")).select("vec_id", F.col("c").cast("long").alias("channel"), (F.round("v", 5) + 0.0).alias("value"))


#: Embeddings as maps of sixteen channels, two by two; the default rank of 64 is cut to the channels.
_ADAPTED = """
    px as (select vec_id, p, list_transform(range(16), lambda c: cast(embedding[c * 4 + p + 1] as double)) as x from embeddings, range(4) t(p)),
    pz as (select vec_id, p, x, list_transform(range(16), lambda r: list_sum(list_transform(range(16), lambda c: ((3 * r + c) % 7 - 3) / 10.0 * x[c + 1])) * list_sum(list_transform(range(16), lambda c: ((5 * r + 2 * c) % 11 - 5) / 10.0 * x[c + 1]))) as z from px),
    pq as (select vec_id, p, x, list_transform(z, lambda v: sign(v) * sqrt(abs(v) + 1e-6)) as z from pz),
    pu as (select vec_id, p, x, list_transform(z, lambda v: v / greatest(sqrt(list_sum(list_transform(z, lambda w: w * w))), 1e-6)) as z from pq),
    py as (select vec_id, p, list_transform(range(16), lambda c: x[c + 1] + 0.5 * list_sum(list_transform(range(16), lambda r: ((c + 2 * r) % 5 - 2) / 10.0 * z[r + 1]))) as y from pu)
"""


def _maps(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    maps = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return adapter.adapt_maps(maps, *adapter_weights(adapter.RANK, 16), scale=0.5, features="embedding", **options).select("vec_id", F.posexplode("adapted").alias("at", "value"))


@query(f"with {_ADAPTED} select vec_id, c * 4 + p as at, round(y[c + 1], 5) + 0.0 as value from py, range(16) t(c)")
def adapter_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _maps(spark, sf_dir).select("vec_id", F.col("at").cast("long").alias("at"), (F.round("value", 5) + 0.0).alias("value"))


@query(f"with {_ADAPTED} select vec_id, k * 4 + p as at, round(k - 1 + list_sum(list_transform(range(16), lambda c: ((k + 3 * c) % 4 - 1) / 4.0 * y[c + 1])), 5) + 0.0 as value from py, range(3) t(k)")
def class_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = [[((k + 3 * c) % 4 - 1) / 4 for c in range(16)] for k in range(3)], [k - 1 for k in range(3)]
    return _maps(spark, sf_dir, branch=head).select("vec_id", F.col("at").cast("long").alias("at"), (F.round("value", 5) + 0.0).alias("value"))
