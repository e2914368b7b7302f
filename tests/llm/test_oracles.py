import pytest
from oracle import compare


@pytest.mark.parametrize("name", ["op1_license_scan", "op2_url_filter", "op7_warc", "op8_line_dedup", "op10_mix", "op11_minhash", "op12_resample", "op13_collocations"])
def test_query_equals_sql(spark, name, sf):
    compare(spark, name, sf)
