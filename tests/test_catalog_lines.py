"""Lines of event catalogs are read without their document."""

import re

from tracewright.sources import catalogs


def test_a_line_does_not_carry_its_document(spark):
    text = "\ufeffNo,Date,Kind\r\n" + "\r\n".join(f"{i},77010203{i % 60:02d},x" for i in range(300)) + "\r\nbad,77,x"
    docs = spark.createDataFrame([(2, "csv", text), (2, "csv", "No,When\n1,7701020304"), (2, "csv", "Date")], "priority int, form string, text string")
    out = catalogs.events_of(docs)
    kept = re.findall(r"Generate explode\(rest#\d+\), \[([^]]*)\]", out._jdf.queryExecution().executedPlan().toString())
    assert kept and all(re.fullmatch(r"place#\d+", k) for k in kept)
    assert out.count() == 60
