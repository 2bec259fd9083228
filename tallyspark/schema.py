"""The transaction frame shared by every operator."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

#: What the sources produce, one row per statement entry.
ENTRY = T.StructType([
    T.StructField("user_id", T.StringType(), False),
    T.StructField("upload_id", T.StringType(), False),
    T.StructField("row_ord", T.LongType(), False),
    T.StructField("tx_date", T.DateType()),
    T.StructField("raw_desc", T.StringType()),
    T.StructField("amount", MONEY),
    T.StructField("tx_type", T.StringType()),
    T.StructField("balance", MONEY),
])

#: Columns of a standardised transaction, in order.
STANDARD = ["user_id", "upload_id", "row_ord", "tx_date", "description", "raw_desc", "amount",
            "tx_type", "balance", "channel", "merchant", "bank", "fingerprint"]

#: Columns added by classification and by recurring-payment detection.
ANNOTATIONS = ["category", "confidence", "classified_by", "is_recurring", "recurring_group"]
