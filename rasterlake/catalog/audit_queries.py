"""Benchmark roll-ups, fits, chunk chains, size reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.catalog.registry import query, r6
from rasterlake.operators import audit, colorspace
from rasterlake.session import work_dir
from rasterlake.sources import readers

col = F.col
ARMS = list(range(1, 8))
_OK = "status = 'ok' and pixel_equal"


@query("s10_read_bench_rows", """select cast(case_id as varchar) case_id, count(*) n, cast(sum(output_bytes) as bigint) out_sum, count(case when pixel_equal then 1 end) equal_n from bench group by 1""")
def _(t):
    folder = work_dir(t.spark, "bench")
    t.bench.select(
        col("case_id").cast("string").alias("case_id"), col("arm_id").cast("string").alias("arm_id"),
        col("pixels").alias("input_bytes"), col("baseline_bytes").alias("baseline_l9_bytes"), "output_bytes",
        (col("output_bytes") / col("baseline_bytes")).alias("ratio_vs_l9"), F.lit(None).cast("double").alias("pct_saved_vs_l9"),
        "pixel_equal", "status", "time_ms").write.option("header", True).option("sep", "\t").csv(folder)
    return readers.read_bench_rows(t.spark, folder, "tsv").groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("output_bytes").alias("out_sum"), F.count_if("pixel_equal").alias("equal_n"))


def _bench_file(t, form: str) -> str:
    """The runs as a benchmark writes them, with lost chunks by name and both decoders."""
    folder = work_dir(t.spark, f"bench-{form}")
    rows = t.bench.select(
        col("case_id").cast("string").alias("case_id"), col("arm_id").cast("string").alias("arm_id"), col("pixels").alias("input_bytes"),
        col("baseline_bytes").alias("baseline_l9_bytes"), "output_bytes", (col("output_bytes") / col("baseline_bytes")).alias("ratio_vs_l9"),
        F.lit(None).cast("double").alias("pct_saved_vs_l9"), "pixel_equal", "status", "time_ms",
        F.when(~col("decode_ok") & (col("run_id") % 2 == 0), False).otherwise(True).alias("decode_ffmpeg"),
        F.when(~col("decode_ok") & (col("run_id") % 2 == 1), False).alias("decode_pillow"),
        F.when(col("chunk_loss"), F.array(F.lit("iCCP"), F.lit("eXIf"))).when(col("run_id") % 3 == 0, F.array().cast("array<string>")).alias("chunk_loss"))
    if form == "tsv":
        cells = [F.coalesce(F.to_json(c) if c == "chunk_loss" else col(c).cast("string"), F.lit("null")).alias(c) for c in rows.columns]
        rows.select(*cells).write.option("header", True).option("sep", "\t").option("quote", "").csv(folder)
    else:
        rows.write.json(folder)
    return folder


_ARMS_SQL = f"""select cast(arm_id as varchar) arm_id, count(case when {_OK} then 1 end) valid,
    round(exp(avg(case when {_OK} then ln(output_bytes::double/baseline_bytes) end)), 6) geo_ratio,
    round((1e0 - sum(case when {_OK} then output_bytes end)::double/sum(case when {_OK} then baseline_bytes end)::double)*100e0, 6) saved_pct,
    count(case when not pixel_equal then 1 end) violations, count(case when chunk_loss then 1 end) chunk_losses,
    count(case when not decode_ok then 1 end) decode_failures, count(case when status = 'timeout' then 1 end) timeouts,
    cast(sum(time_ms) as bigint) total_ms from bench group by arm_id"""


@query("s10_arm_summary_from_tsv", _ARMS_SQL)
def _(t):
    rows = readers.bench_cells(readers.read_bench_rows(t.spark, _bench_file(t, "tsv"), "tsv"))
    return audit.bench_arm_summary(rows).withColumns({"geo_ratio": r6("geo_ratio"), "saved_pct": r6("saved_pct")})


@query("s10_conservation_from_json", """select cast(arm_id as varchar) arm_id, count(*) cells, count(case when status = 'ok' and pixel_equal then 1 end) passed,
    count(case when status = 'fail' or (status = 'ok' and not pixel_equal) then 1 end) failed, count(case when status = 'skip' then 1 end) skipped,
    count(case when status = 'timeout' then 1 end) timed_out, true conserved from bench group by arm_id""")
def _(t):
    """JSON lines: the reader's array form takes them too."""
    return audit.bench_conservation(readers.bench_cells(readers.read_bench_rows(t.spark, _bench_file(t, "json"), "jsonl")))


@query("a18_bench_arm_summary", f"""select arm_id, count(case when {_OK} then 1 end) valid,
    round(exp(avg(case when {_OK} then ln(output_bytes::double/baseline_bytes) end)), 6) geo_ratio,
    round((1e0 - sum(case when {_OK} then output_bytes end)::double/sum(case when {_OK} then baseline_bytes end)::double)*100e0, 6) saved_pct,
    count(case when not pixel_equal then 1 end) violations, count(case when chunk_loss then 1 end) chunk_losses,
    count(case when not decode_ok then 1 end) decode_failures, count(case when status = 'timeout' then 1 end) timeouts,
    cast(sum(time_ms) as bigint) total_ms from bench group by arm_id""")
def _(t):
    return audit.bench_arm_summary(t.bench).withColumns({"geo_ratio": r6("geo_ratio"), "saved_pct": r6("saved_pct")})


@query("a19_bench_matrix", "with c as (select case_id, arm_id, case when not pixel_equal then 'loss' when status <> 'ok' then status else printf('%.2f%%', round((1e0-output_bytes::double/baseline_bytes)*100e0, 2)) end mark, "
       "row_number() over (partition by case_id, arm_id order by run_id, output_bytes, status, pixel_equal) rn from bench) select case_id, "
       + ", ".join(f"max(case when arm_id = {a} then mark end) \"{a}\"" for a in ARMS) + " from c where rn = 1 group by case_id")
def _(t):
    return audit.bench_matrix(t.bench, ARMS)


@query("a20_bench_conservation", f"""select *, passed + failed + skipped + timed_out = cells conserved from (select arm_id, count(*) cells, count(case when {_OK} then 1 end) passed,
    count(case when status = 'fail' or (status = 'ok' and not pixel_equal) then 1 end) failed, count(case when status = 'skip' then 1 end) skipped,
    count(case when status = 'timeout' then 1 end) timed_out from bench group by arm_id)""")
def _(t):
    return audit.bench_conservation(t.bench)


@query("a21_throughput_best_of", """with b as (select case_id, arm_id, min(time_ms) best_ms, max(time_ms) - min(time_ms) spread, max(pixels)/1e6/(min(time_ms)/1000e0) m from bench group by 1, 2)
    select b.case_id, b.arm_id, b.best_ms, b.spread, round(b.m, 9) mpix_s, round(b.m/x.m, 9) gain from b left join b x on x.case_id = b.case_id and x.arm_id = 1""")
def _(t):
    return audit.throughput_best_of(t.bench, 1).select(
        "case_id", "arm_id", "best_ms", "spread", F.round("mpix_s", 9).alias("mpix_s"), F.round("gain", 9).alias("gain"))


_FITX = "case when {k} % 4 = 0 then cast(l_quantity as double) when {k} % 4 = 1 then cast(l_quantity as double) else 7e0 end"
_FITY = "case when {k} % 4 = 0 then l_quantity * 0.02e0 - 1e0 else l_extendedprice / 1000e0 end"


def _fit(expr):
    return expr.format(k="l_suppkey")


@query("a22_linear_fit", f"""with s as (select l_suppkey field, {_fit(_FITX)} x, {_fit(_FITY)} y from lineitem),
    f as (select field, count(*) n, case when count(distinct x) > 1 then regr_slope(y, x) end slope, case when count(distinct x) > 1 then regr_intercept(y, x) end intercept, max(y)-min(y) span, max(abs(y)) top from s group by field),
    r as (select field, max(abs(y-(slope*x+intercept))) mr from s join f using (field) group by field)
    select field, n, round(slope, 6) slope, round(intercept, 5) intercept, round(mr, 5) max_resid,
    case when n < 5 then 'too_few' when slope is null then 'no_x_variance' when mr/(case when span > 0 then span when top > 0 then top else 1e0 end) > 0.02e0 then 'residual' end reject_reason
    from f join r using (field)""")
def _(t):
    s = t.lineitem.selectExpr("l_suppkey field", f"{_fit(_FITX)} x", f"{_fit(_FITY)} y", "l_orderkey", "l_linenumber")
    return audit.linear_fit(s, "field", "x", "y", ["l_orderkey", "l_linenumber"]).select(
        "field", "n", r6("slope", "slope"), F.round("intercept", 5).alias("intercept"), F.round("max_resid", 5).alias("max_resid"), "reject_reason")


@query("a23_power_basis_fit", """with s as (select l_quantity/50e0 x, l_extendedprice/10000e0 y from lineitem),
    m as (select sum(x*x) a, sum(x*x*x*x) b, sum(pow(x,6)) c, sum(x*y) p, sum(x*x*x*y) q from s),
    k as (select (p*c-q*b)/(a*c-b*b) k1, (a*q-b*p)/(a*c-b*b) k3 from m), r as (select max(abs(y-(k1*x+k3*x*x*x))) mr from s, k)
    select 1 power, round(k1, 5) coef, round(mr, 5) max_resid from k, r union all select 3, round(k3, 5), round(mr, 5) from k, r""")
def _(t):
    s = t.lineitem.selectExpr("l_quantity / 50D x", "l_extendedprice / 10000D y")
    return audit.power_basis_fit(s, "x", "y", [1, 3]).select(
        "power", F.round("coef", 5).alias("coef"), F.round("max_resid", 5).alias("max_resid"))


@query("a24_matrix_row_sum_check", """select asset_id, round(d, 8) max_dev, d <= 0.45e0 ok from (select asset_id, greatest(abs(m0+m1+m2-1e0), abs(m3+m4+m5-1e0), abs(m6+m7+m8-1e0)) d from mats)""")
def _(t):
    return colorspace.matrix_row_sum_check(t.mats, [f"m{i}" for i in range(9)], tol=0.45).select("asset_id", F.round("max_dev", 8).alias("max_dev"), "ok")


@query("a28_memory_demand", """select brand, count(*) assets, cast(sum(width::bigint*height) as bigint) pixels, round(max(70e0+99e0*(width::bigint*height/1e6)), 6) max_mb,
    round(count(*)*70e0+sum(width::bigint*height)/1e6*99e0, 6) total_mb from assets group by brand""")
def _(t):
    return audit.memory_demand(t.assets, "brand").select("brand", "assets", "pixels", r6("max_mb", "max_mb"), r6("total_mb", "total_mb"))


@query("j25_reconcile_size", """with d as (select asset_id, width::bigint w, height::bigint h, case asset_id % 5 when 0 then width::bigint*height when 1 then (width//2)::bigint*(height//2)
    when 2 then width::bigint*height*9 when 3 then 0 else width::bigint*height+1 end n, asset_id % 3 <> 0 crop from assets),
    k as (select d.*, (select min(k) from range(2, 17) r(k) where w % k = 0 and h % k = 0 and (w//k)*(h//k) = n) dn, (select min(k) from range(2, 17) r(k) where w*k*h*k = n) up from d),
    v as (select *, case when n <= 0 or w*h = n then 'Match' when not crop then 'RejectUndeclared' when dn is not null or up is not null then 'Scaled' else 'RejectNonUniform' end verdict from k)
    select asset_id, verdict, case when verdict = 'Scaled' then case when dn is not null then w//dn else w*up end else w end actual_w,
    case when verdict = 'Scaled' then case when dn is not null then h//dn else h*up end else h end actual_h from v""")
def _(t):
    a = t.assets.select("asset_id", "width", "height", (col("asset_id") % 3 != 0).alias("crop_declared"))
    d = t.assets.selectExpr("asset_id", """case asset_id % 5 when 0 then cast(width as bigint)*height when 1 then cast(width div 2 as bigint)*(height div 2)
        when 2 then cast(width as bigint)*height*9 when 3 then 0 else cast(width as bigint)*height+1 end pixels""")
    return audit.reconcile_size(a, d)


@query("w07_chunk_chain_check", """with l as (select *, off = coalesce(lag(off + size) over (partition by asset_id order by seq), 0) good from boxes)
    select asset_id, count(*) boxes, bool_and(good) contiguous, bool_and(size >= 40) sizes_ok, bool_and(good) and bool_and(size >= 40) and max_by(off + size, seq) = max(file_len) complete
    from l join box_lengths using (asset_id) group by asset_id""")
def _(t):
    return audit.chunk_chain_check(t.boxes, t.box_lengths, header=40, width=3)


@query("w08_png_structure", """with f as (select asset_id, count(*) chunks, min_by(type, seq) ft, min_by(length, seq) fl, min_by(bit_depth, seq) bd, min_by(color_type, seq) ct,
    max_by(type, seq) lt, max_by(length, seq) ll, count(case when type = 'IEND' then 1 end) ends from png_chunks group by asset_id),
    e as (select asset_id, chunks, case when ft <> 'IHDR' then 'first_not_header' when fl <> 13 then 'header_length'
    when not ((ct = 2 and bd in (8,16)) or (ct = 3 and bd in (1,2,4,8)) or (ct = 6 and bd in (8,16))) then 'depth_color_pair'
    when ends = 0 then 'end_missing' when lt <> 'IEND' or ends > 1 then 'data_after_end' when ll <> 0 then 'end_length' end error from f)
    select asset_id, chunks, error, error is null ok from e""")
def _(t):
    return audit.png_structure(t.png_chunks)
