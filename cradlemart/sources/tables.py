"""Reading the marketplace tables and feeds, appending rows and publishing snapshots."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import TABLES


def load_tables(spark: SparkSession, path: str, only: list[str] | None = None) -> dict[str, DataFrame]:
    """The marketplace tables under ``path``, one parquet folder each, columns matched by name."""
    return {
        name: spark.read.schema(schema).parquet(f"{path}/{name}")
        for name, schema in TABLES.items()
        if only is None or name in only
    }


def read_feed(
    spark: SparkSession, path: str, schema: str, fmt: str = "parquet", max_files: int = 1000, **options: str
) -> DataFrame:
    """A change feed as a stream; ``max_files`` bounds one micro-batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).options(**options)
    return reader.format(fmt).load(path)


def append(df: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Add rows. With a batch id a repeated batch replaces its own rows instead of adding them again."""
    if batch_id is None:
        df.write.mode("append").parquet(path)
    else:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def publish(df: DataFrame, path: str, version: int) -> None:
    """Write a whole snapshot. Readers see it once the job has committed it (its _SUCCESS file)."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def committed_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the snapshots under ``path`` that are complete, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")) or []
    return sorted(int(status.getPath().getParent().getName().split("=")[1]) for status in found)


def read_snapshot(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The newest complete snapshot (older than ``before`` if given); no rows when there is none.

    A stream that runs a batch again reads the snapshot before that batch, so the result is the same.
    """
    versions = [v for v in committed_versions(spark, path) if before is None or v < before]
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/version={versions[-1]}")


# The stored tables behind each name the operators use: new name -> stored name, or (sale, rental) names.
SINGLE = {
    "account": ("t_account", {
        "account_id": "accountId", "account_name": "accountName", "icon": "icon", "email": "emailAddress",
        "lastname": "lastname", "firstname": "firstname", "lastname_kana": "lastnamekana",
        "firstname_kana": "firstnamekana", "birthday": "birthDate", "gender": "gender",
        "phone": "phonenumber", "children": "numberofchildren", "points": "points",
    }),
    "address": ("t_address", {
        "address_id": "addressId", "account_id": "accountId", "postal_code": "postalCode",
        "prefecture": "prefecture", "city_ward": "cityWard", "address_number": "addressNumber",
        "building": "buildingName",
    }),
    "category": ("t_category", {"category_id": "categoryId", "category_name": "categoryName"}),
    "follow": ("t_follow", {"follow_id": "followId", "followed_id": "accountId", "follower_id": "followerId"}),
    "post": ("t_post", {
        "post_id": "postId", "account_id": "accountId", "title": "postTitle", "posted_at": "postDateTime",
        "visibility": "postVisibilityStatus", "deleted": "postDeletionStatus",
    }),
    "post_content": ("t_postContent", {"content_id": "postContentId", "post_id": "postId", "text": "postText"}),
    "post_media": ("t_postMedia", {"media_id": "postMediaId", "content_id": "postContentId", "path": "postAttachedMedia"}),
    "dm": ("t_directMessage", {
        "dm_id": "directMessageId", "receiver_id": "accountId", "sender_id": "senderId",
        "content": "directMessageContent", "media": "directMessageAttachedMedia",
        "sent_at": "directSendDateTime", "deleted": "directMessageDeletionStatus",
    }),
}
_LISTING = ("saleId", "rentalId")
TWINS = {
    "listing": ("", {
        "listing_id": _LISTING, "seller_id": ("accountId", "accountId"), "category_id": ("categoryId", "categoryId"),
        "name": ("productName", "rentalProductName"), "condition": ("productCondition", "rentalProductCondition"),
        "description": ("productDescription", "rentalDescription"), "price": ("sellingPrice", "rentalPrice"),
        "shipping_payer": ("shippingPayer", "rentalShippingPayer"),
        "shipping_estimate": ("shippingEstimate", "rentalShippingEstimate"), "rental_period": (None, "rentalPeriod"),
        "listed_at": ("listingDateTime", "rentalListingDateTime"), "status": ("listingStatus", "rentalListingStatus"),
        "deleted": ("deletionStatus", "rentalDeletionStatus"),
    }),
    "category_status": ("CategoryStatus", {
        "status_id": ("saleCategoryStatusId", "rentalCategoryStatusId"), "listing_id": _LISTING,
        "category_id": ("categoryId", "categoryId"),
    }),
    "photo": ("Photo", {
        "photo_id": ("salePhotoId", "rentalPhotoId"), "listing_id": _LISTING, "path": ("productPhoto", "rentalPhoto"),
    }),
    "comment": ("Comment", {
        "comment_id": ("saleCommentId", "rentalCommentId"), "listing_id": _LISTING,
        "author_id": ("accountId", "accountId"), "content": ("productCommentContent", "rentalCommentContent"),
        "deleted": ("productCommentDeletionStatus", "rentalCommentDeletionStatus"),
    }),
    "transaction": ("Transaction", {
        "transaction_id": ("saleTransactionId", "rentalTransactionId"), "listing_id": _LISTING,
        "buyer_id": ("accountId", "accountId"), "payment_method": ("productPaymentMethod", "rentalPaymentMethod"),
        "status": ("productTransactionStatus", "rentalTransactionStatus"),
    }),
}
CHANNELS = ("sale", "rental")


def _twins(halves: tuple[DataFrame, DataFrame], columns: dict[str, tuple[str | None, str]]) -> DataFrame:
    """The sale and rental halves of a table under common names, with their ``channel``."""
    parts = [
        half.select(F.lit(channel).alias("channel"), *[F.col(pair[side]).alias(new) for new, pair in columns.items() if pair[side]])
        for side, (channel, half) in enumerate(zip(CHANNELS, halves, strict=True))
    ]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def catalog(sale: DataFrame, rental: DataFrame) -> DataFrame:
    """Sales and rentals as one listing table with a ``channel`` column."""
    return _twins((sale, rental), TWINS["listing"][1])


def marketplace(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The stored tables under the names the operators use, sale and rental twins joined into one."""
    views = {
        name: tables[table].select(*[F.col(old).alias(new) for new, old in columns.items()])
        for name, (table, columns) in SINGLE.items()
    }
    for name, (suffix, columns) in TWINS.items():
        views[name] = _twins((tables[f"t_sale{suffix}"], tables[f"t_rental{suffix}"]), columns)
    return views


def _as_stored(rows: DataFrame, table: str, columns: dict[str, str]) -> DataFrame:
    """Rows with a stored table's columns and types; what the rows do not have is null."""
    there = {old: new for new, old in columns.items() if new in rows.columns}
    fields = StructType.fromDDL(TABLES[table]).fields
    return rows.select(
        *[(F.col(there[f.name]) if f.name in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    )


def unmarketplace(views: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The way back: rows under the operators' names as rows of the stored tables, ready to be appended.

    Takes any of the views, so new rows of one kind can be written alone. Sales and rentals are
    told apart by ``channel``. Columns that a view does not have, such as passwords, are null.
    """
    tables = {}
    for name, rows in views.items():
        if name in SINGLE:
            table, columns = SINGLE[name]
            tables[table] = _as_stored(rows, table, columns)
        else:
            suffix, columns = TWINS[name]
            for side, channel in enumerate(CHANNELS):
                table = f"t_{channel}{suffix}"
                names = {new: pair[side] for new, pair in columns.items() if pair[side]}
                tables[table] = _as_stored(rows.where(F.col("channel") == channel), table, names)
    return tables


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], version: int) -> None:
    """Write whole tables to new folders and switch to all of them at once.

    The switch is one row added to the manifest, so readers see either none or all of the tables of
    a commit. Committed folders are never written again; a repeated commit of a version replaces it.
    """
    paths = {}
    for name, rows in tables.items():
        paths[name] = f"{root}/{name}/{version}-{uuid.uuid4().hex}"
        rows.write.parquet(paths[name])
    row = spark.createDataFrame([(version, time.time_ns(), paths)], MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{root}/_manifest")


MANIFEST = "version bigint, written bigint, paths map<string,string>"


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{root}/_manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], MANIFEST)
    return rows.select("version", "written", F.explode("paths").alias("name", "path"))


def committed(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The newest committed state of every table under ``root``."""
    newest = _manifest(spark, root).groupBy("name").agg(F.max_by("path", F.struct("version", "written")).alias("path"))
    return {r["name"]: spark.read.parquet(r["path"]) for r in newest.toLocalIterator()}


def superseded(spark: SparkSession, root: str) -> DataFrame:
    """(name, path) of committed folders that later commits have replaced and that may be removed."""
    rows = _manifest(spark, root)
    newest = rows.groupBy("name").agg(F.max_by("path", F.struct("version", "written")).alias("path"))
    return rows.select("name", "path").distinct().join(newest, ["name", "path"], "left_anti")


def for_key(views: dict[str, DataFrame], **key: object) -> dict[str, DataFrame]:
    """The views narrowed to one key, such as ``account_id=7`` or ``post_id="00003"``.

    The filter is put on every view that has the key's columns, so it reaches their scans.
    """
    test = F.lit(True)
    for column, value in key.items():
        test = test & (F.col(column) == value)
    return {name: df.where(test) if set(key) <= set(df.columns) else df for name, df in views.items()}


def for_listing(views: dict[str, DataFrame], channel: str, listing_id: str) -> dict[str, DataFrame]:
    """The views narrowed to one listing, for a single item page.

    The filter is put on every table that knows the listing. Spark would not carry it over from a
    filter on the joined result, since one half of the sale and rental union is empty then.
    """
    return for_key(views, channel=channel, listing_id=listing_id)
