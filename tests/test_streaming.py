"""K1: the incremental job processes only new files and resumes from its checkpoint."""
from pyspark.sql import functions as F

from delayspark.operators import catalogue as CAT
from delayspark.session import read_table
from delayspark.sources import capture as CP
from delayspark.sources.sinks import scratch_path
from delayspark.streaming import incremental as INC

SF = "/root/testdata/sf0.001"


def test_two_runs_equal_one(spark):
    pages = read_table(spark, SF, "pages")
    s = CP.search_results(pages).drop("page_id")
    pk, fl, rc = CP.packages(pages), CP.datastore_fields(pages), CP.resource_records(pages)
    root = scratch_path(spark, "stream-test")
    landing, output, ckpt = f"{root}/landing", f"{root}/out", f"{root}/ckpt"
    first = F.abs(F.hash("name")) % 3 == 0
    INC.land(s.where(first), landing, records_per_file=5)
    INC.run_incremental_enrich(spark, landing, output, ckpt, s.schema, pk, fl, rc, files_per_batch=1)
    batches_1 = spark.read.parquet(output).select("batch").distinct().count()
    # a "restart": same checkpoint, new files landed meanwhile
    INC.land(s.where(~first), landing, records_per_file=5)
    INC.run_incremental_enrich(spark, landing, output, ckpt, s.schema, pk, fl, rc, files_per_batch=1)
    batches_2 = spark.read.parquet(output).select("batch").distinct().count()
    assert batches_1 >= 1 and batches_2 > batches_1
    # a third run with nothing new does nothing
    INC.run_incremental_enrich(spark, landing, output, ckpt, s.schema, pk, fl, rc, files_per_batch=1)
    assert spark.read.parquet(output).select("batch").distinct().count() == batches_2
    got = INC.final_table(spark, output)
    want = CAT.enrich(s, pk, fl, rc).drop("page_id")
    cols = sorted(want.columns)
    a, b = got.select(*cols), want.select(*cols)
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
