"""Queries on events, orders and generated rectangles: intervals, joins, spatial labels, samples, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from glosswright.functions import geometry, text as t
from glosswright.operators import evaluation, intervals, sampling, spatial, store, tagging
from glosswright.plans.registry import query, table
from glosswright.session import shared_folder
from glosswright.streaming import events as stream


def _spans(spark, sf_dir):
    """Events as half-open intervals of a few minutes, by user."""
    e = table(spark, sf_dir, "events")
    start = F.unix_timestamp(F.col("ts").cast("timestamp")) / 60
    return e.select("user_id", F.floor(start).cast("long").alias("start"), (F.floor(start) + 1 + F.col("event_id") % 45).cast("long").alias("end"))


_SPANS = "sp AS (SELECT user_id, floor(epoch(ts) / 60)::BIGINT AS s, floor(epoch(ts) / 60)::BIGINT + 1 + event_id % 45 AS e FROM events)"


def _merged(gap: int) -> str:
    return f"""WITH {_SPANS}, r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach >= {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM r)
SELECT user_id, min(s) AS "start", max(e) AS "end", count(*) AS n_merged FROM g GROUP BY user_id, g"""


@query(_merged(5))
def interval_merge(spark, sf_dir):
    return intervals.merge_intervals(_spans(spark, sf_dir), ["user_id"], gap=5)


@query(_merged(100))
def interval_merge_chunks(spark, sf_dir):
    return intervals.merge_intervals(_spans(spark, sf_dir), ["user_id"], gap=100)


@query("""WITH d AS (SELECT DISTINCT user_id, (date_diff('day', TIMESTAMP '1970-01-01', ts))::BIGINT AS day FROM events),
g AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM d)
SELECT user_id, min(day) AS "first", max(day) AS "last" FROM g GROUP BY user_id, g""")
def islands(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"))
    return intervals.islands(e, ["user_id"], "day")


@query(f"""WITH {_SPANS}, b AS (SELECT max(e) + 60 AS bound, min(s) - 60 AS low FROM sp),
r AS (SELECT user_id, s, e, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
free AS (SELECT user_id, coalesce(reach, low) AS a, s AS b FROM r, b UNION ALL SELECT user_id, max(e), (SELECT bound FROM b) FROM sp GROUP BY user_id)
SELECT user_id, a AS "start", b AS "end" FROM free WHERE a < b""")
def complement(spark, sf_dir):
    s = _spans(spark, sf_dir)
    low, high = s.agg(F.min("start"), F.max("end")).first()
    return intervals.complement(s, ["user_id"], F.lit(high + 60).cast("long"), low=low - 60)


@query(f"""WITH {_SPANS}, cov AS (SELECT DISTINCT user_id, unnest(range(s, e)) AS m FROM sp), hole AS (
  SELECT user_id, s + 2 AS s, s + 4 AS e FROM sp), gone AS (SELECT DISTINCT user_id, unnest(range(s, e)) AS m FROM hole),
left_ AS (SELECT user_id, m FROM cov EXCEPT SELECT user_id, m FROM gone), g AS (SELECT *, m - row_number() OVER (PARTITION BY user_id ORDER BY m) AS g FROM left_)
SELECT user_id, min(m) AS "start", max(m) + 1 AS "end" FROM g GROUP BY user_id, g""")
def interval_subtract(spark, sf_dir):
    s = _spans(spark, sf_dir)
    holes = s.select("user_id", (F.col("start") + 2).alias("start"), (F.col("start") + 4).alias("end"))
    return intervals.subtract(s, holes, ["user_id"])


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_linenumber // 3 AS line, l_quantity AS x0, l_discount AS y0, l_quantity + 1 AS x1, l_discount + l_tax AS y1 FROM lineitem)
SELECT l_orderkey, line, min(l_linenumber) AS l_linenumber, min(x0) AS x0, round(min(y0), 6) AS y0, max(x1) AS x1, round(max(y1), 6) AS y1, count(*) AS n_boxes FROM b GROUP BY l_orderkey, line""")
def line_box_merge(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.floor(F.col("l_linenumber") / 3).cast("int").alias("line"), F.col("l_quantity").alias("x0"), F.col("l_discount").alias("y0"),
        (F.col("l_quantity") + 1).alias("x1"), (F.col("l_discount") + F.col("l_tax")).alias("y1"),
    )
    out = intervals.merge_line_boxes(b, ["l_orderkey"], "l_linenumber")
    return out.withColumn("y0", F.round("y0", 6)).withColumn("y1", F.round("y1", 6))


# Pages of made rectangles: 40 words on a grid and 6 marks on each of a document's pages.
_RECTS = """words AS (SELECT doc_id AS doc, p.page, w.word_no, (w.word_no % 8) * 10.0::DOUBLE AS x0, (w.word_no // 8) * 5.0::DOUBLE AS y0,
    (w.word_no % 8) * 10.0::DOUBLE + 4 + (doc_id + w.word_no) % 6 AS x1, (w.word_no // 8) * 5.0::DOUBLE + 4 AS y1
  FROM documents, (SELECT unnest(range(0, 2)) AS page) p, (SELECT unnest(range(0, 40)) AS word_no) w),
marks AS (SELECT doc_id AS doc, p.page, m.mark_no, ((doc_id * 7 + m.mark_no * 13) % 70)::DOUBLE AS x0, ((doc_id * 3 + m.mark_no * 5) % 22)::DOUBLE AS y0,
    ((doc_id * 7 + m.mark_no * 13) % 70)::DOUBLE + 3 + (doc_id * m.mark_no) % 20 AS x1, ((doc_id * 3 + m.mark_no * 5) % 22)::DOUBLE + 1 + (doc_id + m.mark_no) % 8 AS y1
  FROM documents, (SELECT unnest(range(0, 2)) AS page) p, (SELECT unnest(range(0, 6)) AS mark_no) m)"""
_AREA = "greatest(least(w.x1, m.x1) - greatest(w.x0, m.x0), 0) * greatest(least(w.y1, m.y1) - greatest(w.y0, m.y0), 0) / ((w.x1 - w.x0) * (w.y1 - w.y0))"


def _rect(x0, y0, x1, y1):
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def _pages(spark, sf_dir, n, name):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"))
    return d.select("doc", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("page")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name))


def _words(spark, sf_dir):
    w, d = F.col("word_no"), F.col("doc")
    x, y = (w % 8) * 10.0, F.floor(w / 8) * 5.0
    return _pages(spark, sf_dir, 40, "word_no").withColumn("rect", _rect(x, y, x + 4 + (d + w) % 6, y + 4))


def _marks(spark, sf_dir):
    m, d = F.col("mark_no"), F.col("doc")
    x, y = (d * 7 + m * 13) % 70, (d * 3 + m * 5) % 22
    return _pages(spark, sf_dir, 6, "mark_no").withColumn("rect", _rect(x, y, x + 3 + (d * m) % 20, y + 1 + (d + m) % 8))


@query(f"""WITH {_RECTS} SELECT w.doc, w.page::INTEGER AS page, w.word_no::INTEGER AS word_no, max(CASE WHEN {_AREA} > 0.5 THEN 1 ELSE 0 END)::INTEGER AS label
FROM words w JOIN marks m ON w.doc = m.doc AND w.page = m.page GROUP BY w.doc, w.page, w.word_no""")
def spatial_word_label(spark, sf_dir):
    return spatial.word_labels(_words(spark, sf_dir), _marks(spark, sf_dir)).select("doc", "page", "word_no", "label")


@query(f"""WITH {_RECTS} SELECT w.doc, w.page::INTEGER AS page, w.word_no::INTEGER AS word_no, coalesce('tag' || max(CASE WHEN {_AREA} > 0.5 THEN m.mark_no END), '') AS tag
FROM words w JOIN marks m ON w.doc = m.doc AND w.page = m.page GROUP BY w.doc, w.page, w.word_no""")
def spatial_word_tag(spark, sf_dir):
    marks = _marks(spark, sf_dir).withColumn("tag", F.concat(F.lit("tag"), F.col("mark_no")))
    return spatial.word_tags(_words(spark, sf_dir), marks).select("doc", "page", "word_no", "tag")


@query(f"""WITH {_RECTS}, notes AS (SELECT doc, page, word_no AS note_no, x0 + 1 AS x, y0 + 1 AS y FROM words WHERE word_no % 7 = 0)
SELECT n.doc, n.page::INTEGER AS page, n.note_no::INTEGER AS note_no, coalesce(min(CASE WHEN n.x BETWEEN m.x0 AND m.x1 AND n.y BETWEEN m.y0 AND m.y1 THEN m.mark_no END), -1)::INTEGER AS mark_no
FROM notes n JOIN marks m ON n.doc = m.doc AND n.page = m.page GROUP BY n.doc, n.page, n.note_no""")
def note_pairing(spark, sf_dir):
    notes = _words(spark, sf_dir).where("word_no % 7 = 0").select("doc", "page", F.col("word_no").alias("note_no"), (F.col("rect.x0") + 1).alias("x"), (F.col("rect.y0") + 1).alias("y"))
    return spatial.note_marks(notes, _marks(spark, sf_dir)).select("doc", "page", "note_no", F.coalesce("mark_no", F.lit(-1)).alias("mark_no"))


_TOUCH = "w.x0 <= m.x1 AND m.x0 <= w.x1 AND w.y0 <= m.y1 AND m.y0 <= w.y1"


@query(f"""WITH {_RECTS}, t AS (SELECT w.doc, w.page, w.word_no, max(CASE WHEN {_TOUCH} THEN 1 ELSE 0 END) AS inside FROM words w JOIN marks m ON w.doc = m.doc AND w.page = m.page GROUP BY ALL)
SELECT doc, page::INTEGER AS page, sum(inside)::BIGINT AS n_inside, sum(1 - inside)::BIGINT AS n_outside FROM t GROUP BY doc, page""")
def glyph_mark(spark, sf_dir):
    w, m = _words(spark, sf_dir), _marks(spark, sf_dir)
    both = spatial.glyphs_in(w, m).withColumn("i", F.lit(1)).unionByName(spatial.glyphs_outside(w, m).withColumn("i", F.lit(0)))
    return both.groupBy("doc", "page").agg(F.sum("i").alias("n_inside"), F.sum(1 - F.col("i")).alias("n_outside"))


@query(f"""WITH {_RECTS} SELECT w.doc, w.page::INTEGER AS page, m.mark_no::INTEGER AS mark_no, string_agg(chr((97 + w.word_no % 26)::INTEGER), '' ORDER BY w.word_no) AS text
FROM words w JOIN marks m ON w.doc = m.doc AND w.page = m.page AND {_TOUCH} GROUP BY w.doc, w.page, m.mark_no""")
def marked_text(spark, sf_dir):
    g = _words(spark, sf_dir).withColumn("glyph_no", F.col("word_no")).withColumn("ch", F.char(97 + F.col("word_no") % 26))
    return spatial.marked_text(g, _marks(spark, sf_dir))


@query(f"""WITH {_RECTS} SELECT doc, page::INTEGER AS page, mark_no::INTEGER AS mark_no, x0, 100 - y1 AS y0, x1, 100 - y0 AS y1 FROM marks""")
def flip_axis(spark, sf_dir):
    m = _marks(spark, sf_dir).withColumn("f", geometry.flipped("rect", F.lit(100.0)))
    return m.select("doc", "page", "mark_no", "f.*")


@query("SELECT event_type AS tag, count(*) AS n, (dense_rank() OVER (ORDER BY event_type))::INTEGER AS idx FROM events GROUP BY event_type UNION ALL SELECT '', 0, 0")
def class_frequency(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("tag"))
    return tagging.class_frequency(e, tagging.class_list(e))


@query("SELECT event_id, (SELECT count(DISTINCT event_type) FROM events f WHERE f.event_type <= e.event_type)::INTEGER AS idx FROM events e")
def class_index(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("tag"))
    return tagging.class_index(e, tagging.class_list(e)).select("event_id", "idx")


@query("""WITH l AS (SELECT doc_id, toxic AS label, row_number() OVER (PARTITION BY toxic <> 0 ORDER BY md5('42:' || doc_id)) AS r FROM labels)
SELECT doc_id, label FROM l WHERE label <> 0 OR r <= 3 * (SELECT count(*) FROM labels WHERE toxic <> 0)""")
def negative_sample(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return sampling.balanced(labels, "doc_id", ratio=3)


@query("""SELECT event_id, loc AS location_type, CASE loc WHEN 'top_left' THEN value ELSE value + 1 END AS xvalue, CASE loc WHEN 'top_left' THEN user_id ELSE user_id + 1 END::DOUBLE AS yvalue, (event_id % 5)::INTEGER AS page
FROM events, (VALUES ('top_left'), ('bottom_right')) v(loc) WHERE value IS NOT NULL""")
def unpivot_corners(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    point = lambda d: F.struct((F.col("value") + d).alias("x"), (F.col("user_id") + d).cast("double").alias("y"))
    p = F.array(F.struct(point(0).alias("top_left"), point(1).alias("bottom_right"), (F.col("event_id") % 5).cast("int").alias("page")))
    c = store.corners(e.select(F.col("event_id").alias("id"), p.alias("positions")))
    return c.select(F.col("annotationid").alias("event_id"), "location_type", "xvalue", "yvalue", "page")


@query("SELECT c_custkey AS document_id, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name <> ''")
def group_documents(spark, sf_dir):
    groups = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("group_id"), F.col("n_name").alias("name"))
    remote = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_nationkey").alias("group_id"))
    return store.group_documents(remote, groups).select("document_id", "name")


@query("""SELECT o_custkey AS document_id, n_name AS name, count(*) AS n_rects, min(l_linenumber)::INTEGER AS first_page
FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY o_custkey, n_name""")
def left_chain(spark, sf_dir):
    groups = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("group_id"), F.col("n_name").alias("name"))
    remote = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_nationkey").alias("group_id"))
    o = table(spark, sf_dir, "orders")
    links = o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("hash"))
    marks = o.select(F.col("o_orderkey").alias("hash"), F.col("o_orderkey").alias("mark_id"))
    z = F.lit(0.0)
    rects = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mark_id"), F.col("l_linenumber").alias("page"), z.alias("x1"), z.alias("y1"), z.alias("x2"), z.alias("y2"))
    out = store.group_marks(remote, groups, links, marks, rects)
    return out.groupBy("document_id", "name").agg(F.count("*").alias("n_rects"), F.min("page").alias("first_page"))


@query("SELECT o_orderstatus AS author, count(*) AS n_marks, sum(n)::BIGINT AS n_rects FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' GROUP BY 1")
def anti_delete(spark, sf_dir):
    marks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("mark_id"), F.col("o_orderstatus").alias("author"))
    rects = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mark_id"))
    m, r = store.without_automatic(marks, rects, "F")
    n = r.groupBy("mark_id").agg(F.count("*").alias("n"))
    return m.join(n, "mark_id").groupBy("author").agg(F.count("*").alias("n_marks"), F.sum("n").alias("n_rects"))


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def not_yet_written(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return store.not_yet(table(spark, sf_dir, "part").select("p_partkey", "p_name"), done, ["p_partkey"])


_RULE = "CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END"


def _scored(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("predicted"))
    return d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


@query(f"""WITH s AS (SELECT source, quality AS y, {_RULE} AS p FROM documents JOIN labels USING (doc_id))
SELECT source, round(coalesce(sum(y * p) / nullif(sum(p), 0), 0), 9) AS precision, round(coalesce(sum(y * p) / nullif(sum(y), 0), 0), 9) AS recall FROM s GROUP BY source""")
def loo_precision_recall(spark, sf_dir):
    r = evaluation.precision_recall(_scored(spark, sf_dir), "source")
    return r.select("source", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("""WITH s AS (SELECT source, quality AS y FROM documents JOIN labels USING (doc_id)), g AS (SELECT DISTINCT source FROM s)
SELECT g.source, count(*) AS n, sum(y)::BIGINT AS positives FROM g JOIN s ON s.source <> g.source GROUP BY g.source""")
def loo_statistics(spark, sf_dir):
    return evaluation.statistics_without(_scored(spark, sf_dir), "source").select("source", "n", F.col("positives").cast("long"))


@query("""WITH x AS (SELECT unnest(range(0, len(embedding)))::INTEGER AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM x GROUP BY dim""")
def scaler_fit(spark, sf_dir):
    s = evaluation.scaler(table(spark, sf_dir, "embeddings"), "embedding")
    return s.select("dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("SELECT user_id, arg_min(event_id, (value, event_id)) AS event_id, min(value) AS cost FROM events WHERE value IS NOT NULL GROUP BY user_id")
def argmin_page(spark, sf_dir):
    from glosswright.operators.align import best_page

    e = table(spark, sf_dir, "events").where("value is not null").select("user_id", F.col("event_id").alias("page"), F.col("value").alias("cost"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    return best_page(e, ["user_id"]).select("user_id", F.col("page").alias("event_id"), "cost")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def topk_per_group(spark, sf_dir):
    return spatial.first_match(table(spark, sf_dir, "events"), ["user_id"], "event_id", last=True).select("user_id", "event_id", "value")


@query("SELECT o_orderkey, '#' || lower(printf('%02x%02x%02x', o_orderkey % 256, o_custkey % 256, (o_orderkey + o_custkey) % 256)) AS colour FROM orders")
def colour_hex(spark, sf_dir):
    a, b = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", t.hex_colour(a % 256, b % 256, (a + b) % 256).alias("colour"))


_EVER = "3650 days"  # the files of a stored table come in no order of time: none of their rows is late


def _streamed(spark, sf_dir, plan, mode="complete"):
    """A plan over the events' files run as a stream to its end, into files in the shared folder."""
    folder = f"{shared_folder(spark).rstrip('/')}/stream_{uuid.uuid4().hex}"
    events = stream.event_stream(spark, f"{sf_dir}/events.parquet")
    return stream.drain_to(plan(events), f"{folder}/rows", mode, f"{folder}/checkpoint")


@query("""SELECT (epoch(time_bucket(INTERVAL 1 HOUR, ts)))::BIGINT AS "start", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_tumbling(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda e: stream.tumbling(e, late=_EVER)).select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM g)
SELECT (epoch_us(min(ts)))::BIGINT AS "start", user_id, count(*) AS n FROM s GROUP BY user_id, s""")
def stream_session(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda e: stream.sessions(e, late=_EVER)).select(F.unix_micros("start").alias("start"), "user_id", "n")


@query("SELECT user_id, event_type FROM events GROUP BY user_id, event_type")
def stream_dedup(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda e: stream.distinct_events(e, ["user_id", "event_type"], _EVER), "append").select("user_id", "event_type")


@query("""SELECT (epoch(w))::BIGINT AS "start", event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE for k in [0, 1, 2, 3]]) AS w FROM events) GROUP BY 1, 2""")
def stream_sliding(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda e: stream.sliding(e, late=_EVER)).select(F.unix_seconds("start").alias("start"), "event_type", "n")


@query("""WITH w AS (SELECT o_custkey, o_orderdate, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, o_orderkey FROM orders)
SELECT o_custkey, o_orderkey FROM w WHERE o_totalprice < before AND o_orderkey % 7 < 5""")
def smaller_runs(spark, sf_dir):
    k = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("size"), k.alias("start"), (k + k % 7).alias("end"))
    return intervals.smaller_runs(r, ["o_custkey"]).select("o_custkey", "o_orderkey")
