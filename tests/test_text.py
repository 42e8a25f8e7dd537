from pyspark.sql import functions as F

from roaskit.functions.scalars import strip_markdown, tag_intent
from tests.conftest import SF

# Written by hand: what a reader should see of each text.
SHOWN = {
    "Spend **rose** on Meta": "Spend rose on Meta",
    "__Search__ leads, *video* trails, _display_ is flat": "Search leads, video trails, display is flat",
    "keep snake_case_names and 6*7*8 as they are": "keep snake_case_names and 6*7*8 as they are",
    "## Outlook\n\nGrowth ahead": "Outlook Growth ahead",
    "- cut waste\n* test ads\n• scale winners": "cut waste test ads scale winners",
    "1. first\n 22. second": "first second",
    "many   blanks\n\n\nand lines": "many blanks and lines",
    "  é **ü** ": "é ü",
    "": "",
}


def test_strip_markdown(spark):
    df = spark.createDataFrame([(t,) for t in SHOWN], "t string")
    assert {r.t: r.p for r in df.select("t", strip_markdown("t").alias("p")).collect()} == SHOWN


def test_strip_markdown_leaves_no_marks_in_documents(spark):
    left = spark.read.parquet(f"{SF}/documents.parquet").select(strip_markdown("text").alias("p")).filter(
        F.col("p").contains("\n") | F.col("p").contains("  ") | (F.col("p") != F.trim("p")))
    assert left.count() == 0


def test_intents(spark):
    asked = {
        "Why did revenue drop?": "revenue_drop", "Which channel is best": "best_channel",
        "Should I scale Facebook?": "meta_scale", "How is Google doing": "google", "tell me of Bing": "bing",
        "what is the outlook": "forecast", "how should I split money": "budget", "roas please": "roas",
        "any concern?": "risk", "is pmax good": "campaign_type", "hello": "general"}
    df = spark.createDataFrame([(k,) for k in asked], "t string")
    assert {r.t: r.i for r in df.select("t", tag_intent(F.col("t")).alias("i")).collect()} == asked
