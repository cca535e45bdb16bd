"""A scored run over labelled sentences: precision, recall and F1 of each category, by what finds the entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillveil.operators.detect import detect
from quillveil.operators.evaluate import metrics, nth_span

#: Ten sentences with a labelled span, six that only look like it: text, span, category.
CASES = (
    ("Please write to night.desk@harbourmail.org before noon.", "night.desk@harbourmail.org", "email"),
    ("Our courier can be reached on +91 9812345670 all day.", "+91 9812345670", "phone"),
    ("The gateway answers at 172.16.5.9 inside the plant.", "172.16.5.9", "ip"),
    ("Her PAN, PQRSX6789L, was copied to the ledger.", "PQRSX6789L", "pan"),
    ("His Aadhaar card shows 8765 4321 0987 on the front.", "8765 4321 0987", "aadhaar"),
    ("She was born on 07/11/1984 in the old town.", "07/11/1984", "dob"),
    ("They charged card 4111111111111111 twice last week.", "4111111111111111", "credit_card"),
    ("The form lists SSN 219-09-9999 under dependants.", "219-09-9999", "ssn"),
    ("Meera Pillai was elected treasurer of the club.", "Meera Pillai", "name"),
    ("The pumps came from Lotus Valley Engineering Private Limited.", "Lotus Valley Engineering Private Limited", "company"),
    ("Kindly cite invoice 9812345670 when you pay.", None, None),
    ("The shipment weighed 8765 4321 0987 grams in all.", None, None),
    ("The bridge was opened on 07/11/1984 by the mayor.", None, None),
    ("Folio U4111111111111112 was filed with the clerk.", None, None),
    ("The notice follows RBI Guidelines and SEBI Regulations.", None, None),
    ("The table stands on page 518 of the annual volume.", None, None),
)


def cases(spark: SparkSession) -> DataFrame:
    """Rows (case_id, text, truth)."""
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "case_id int, text string, part string, category string")
    at = nth_span(F.col("text"), F.col("part"), F.lit(1))
    truth = F.when(F.col("part").isNotNull(), F.array(F.struct(at["start"].alias("start"), at["end"].alias("end"), F.col("category").alias("category"))))
    return rows.select("case_id", "text", F.coalesce(truth, F.array().cast("array<struct<start:int,end:int,category:string>>")).alias("truth"))


def run(labelled: DataFrame) -> DataFrame:
    """Rows (text, truth) to backend, category, tp, fp, fn, precision, recall, f1.

    Backend `patterns` has no entities, `rules` those of the rules; categories OVERALL sum up.
    """
    out = None
    for backend, found in (("patterns", None), ("rules", "rules")):
        scored = metrics(detect(labelled, found=found, out="predicted")).select(F.lit(backend).alias("backend"), "*")
        out = scored if out is None else out.unionByName(scored)
    return out
