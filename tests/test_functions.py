"""Column expressions against the standard library."""

import unicodedata
import uuid
from urllib.parse import quote

from pyspark.sql import functions as F

from evidentia.functions import cleaning as T
from evidentia.functions import pages as W

TEXTS = ["", "plain", "Ｆull width ﬁne", "Straße ΑΣ", "a b+c*d~e/f?g=h&i", "日本語 é𝒳", "100%", "new\nline"]


def test_text_functions_equal_the_library(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)] + [(99, None)], "k int, t string")
    space = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    x = F.col("t")
    got = {r.k: r for r in df.select("k", T.folded(x).alias("folded"), T.uuid5(space, x).alias("id"), W.quoted(x).alias("url"), W.quoted(x, "").alias("all")).collect()}
    for k, t in enumerate(TEXTS):
        assert got[k].folded == unicodedata.normalize("NFKC", t).casefold()
        assert got[k].id == str(uuid.uuid5(uuid.UUID(space), t))
        assert got[k].url == quote(t) and got[k].all == quote(t, safe="")
    assert got[99].folded is None and got[99].url is None
