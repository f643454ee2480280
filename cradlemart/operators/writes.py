"""The write side as table-to-table jobs: ids, new rows, edits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import padded_id, parse_birthday, parse_price
from ..schemas import DEFAULT_ICON, LISTED, UPLOAD_DIR
from .catalog import LISTING
from .ordered import running_number, running_sums


def _last_id(existing: DataFrame, id_col: str) -> Column:
    """The largest existing id as a number. Ids compare as numbers, so 99999 is followed by 100000."""
    return existing.agg(F.max(F.col(id_col).try_cast("bigint")).alias("_top")).scalar()


def _last_id_per_channel(rows: DataFrame, existing: DataFrame, id_col: str, name: str) -> DataFrame:
    """Add the largest id of the row's channel; the joined table has one row per channel."""
    top = existing.groupBy("channel").agg(F.max(F.col(id_col).try_cast("bigint")).alias(name))
    return rows.join(F.broadcast(top), "channel", "left")


def _next(last: Column, offset: Column) -> Column:
    return padded_id(F.coalesce(last, F.lit(0)) + offset)


def assign_ids(
    new: DataFrame,
    existing: DataFrame,
    id_col: str,
    order: str,
    ties: list[str | Column] = (),
    per_channel: bool = False,
    existing_id: str | None = None,
) -> DataFrame:
    """Give new rows the ids after the largest existing one, in (order, ties) order.

    ``per_channel`` keeps one sequence for sales and one for rentals.
    """
    known = existing_id or id_col
    if not per_channel:
        numbered = running_number(new, [], order, ties, "_no")
        return numbered.withColumn(id_col, _next(_last_id(existing, known), F.col("_no"))).drop("_no")
    numbered = _last_id_per_channel(running_number(new, ["channel"], order, ties, "_no", cut_all=True), existing, known, "_last")
    return numbered.withColumn(id_col, _next(F.col("_last"), F.col("_no"))).drop("_no", "_last")


def register_accounts(forms: DataFrame, accounts: DataFrame, addresses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted registrations to account and address rows; passwords are not carried over."""
    # One form gives one row in each table, so one numbering serves both.
    numbered = running_number(forms, [], "seq", name="_no").withColumn(
        "account_id", _next(_last_id(accounts, "account_id"), F.col("_no"))
    )
    account = numbered.select(
        "account_id", F.col("username").alias("account_name"), F.lit(DEFAULT_ICON).alias("icon"), "email",
        F.col("name").alias("lastname"), F.col("name_first").alias("firstname"),
        F.col("name_kana").alias("lastname_kana"), F.col("name_kana_first").alias("firstname_kana"),
        parse_birthday(F.col("birthday")).alias("birthday"),
        "gender", "phone", F.col("children_count").try_cast("int").alias("children"),
        F.lit(0).cast("bigint").alias("points"),
    )
    address = numbered.select(
        _next(_last_id(addresses, "address_id"), F.col("_no")).alias("address_id"), "account_id", "postal_code",
        F.col("address").alias("prefecture"), F.col("city").alias("city_ward"),
        F.col("street").alias("address_number"), "building",
    )
    return account, address


def _filled(slot: int) -> Column:
    return F.coalesce(F.get("uploads", F.lit(slot)), F.lit("")) != ""


def _files(slots: int) -> Column:
    """Number of the first ``slots`` upload slots that hold a file."""
    return sum((F.when(_filled(i), 1).otherwise(0) for i in range(slots)), F.lit(0))


def _upload(account: str, slot: Column) -> Column:
    return F.concat_ws("_", F.concat(F.lit(f"{UPLOAD_DIR}/"), F.col(account)), F.col("seq"), slot)


@dataclass
class NewListings:
    listings: DataFrame
    category_status: DataFrame
    photos: DataFrame


def list_items(
    forms: DataFrame, listings: DataFrame, category_status: DataFrame, photos: DataFrame, at: Column
) -> NewListings:
    """Accepted listing forms to listing, category and photo rows (one photo per filled upload slot).

    One running pass numbers the forms and their photos; all ids follow from it.
    """
    totals = {"_no": F.lit(1), "_photos": _files(4)}
    numbered = running_sums(forms, ["channel"], "seq", totals, cut_all=True)
    placed = _last_id_per_channel(numbered, listings, "listing_id", "_last").withColumn(
        "listing_id", _next(F.col("_last"), F.col("_no"))
    )
    new = placed.select(
        *LISTING, F.col("account_id").alias("seller_id"), F.col("categoryId").alias("category_id"),
        F.col("productName").alias("name"), F.col("productCondition").alias("condition"),
        F.col("productDescription").alias("description"), parse_price(F.col("sellingPrice")).alias("price"),
        F.col("shippingPayer").alias("shipping_payer"), F.col("shippingEstimate").alias("shipping_estimate"),
        F.when(F.col("channel") == "rental", F.col("rentalPeriod")).alias("rental_period"), at.alias("listed_at"),
        F.lit(LISTED).alias("status"), F.lit(0).alias("deleted"),
    )
    bridge = _last_id_per_channel(placed, category_status, "status_id", "_last_status").select(
        "channel", _next(F.col("_last_status"), F.col("_no")).alias("status_id"), "listing_id",
        F.col("categoryId").alias("category_id"),
    )
    earlier = F.col("_photos") - _files(4)
    each = [
        F.when(_filled(i), F.struct((earlier + _files(i + 1)).alias("no"), _upload("account_id", F.lit(i + 1)).alias("path")))
        for i in range(4)
    ]
    shown = placed.select(*LISTING, F.explode(F.array(*each)).alias("p")).where(F.col("p").isNotNull())
    pictures = _last_id_per_channel(shown, photos, "photo_id", "_last_photo").select(
        "channel", _next(F.col("_last_photo"), F.col("p.no")).alias("photo_id"), "listing_id", "p.path"
    )
    return NewListings(new, bridge, pictures)


@dataclass
class NewPosts:
    posts: DataFrame
    contents: DataFrame
    media: DataFrame


def publish_posts(forms: DataFrame, posts: DataFrame, contents: DataFrame, media: DataFrame, at: Column) -> NewPosts:
    """Post forms to a post, its four contents (empty ones too) and one media row per filled upload."""
    numbered = running_sums(forms, [], "seq", {"_no": F.lit(1), "_files": _files(4)})
    placed = numbered.withColumn("post_id", _next(_last_id(posts, "post_id"), F.col("_no")))
    content_no = [(F.col("_no") - 1) * 4 + i + 1 for i in range(4)]
    content = [F.struct(content_no[i].alias("no"), F.get("contents", F.lit(i)).alias("text")) for i in range(4)]
    file = [
        F.when(
            _filled(i),
            F.struct(
                (F.col("_files") - _files(4) + _files(i + 1)).alias("no"), content_no[i].alias("content_no"),
                F.concat_ws("_", _upload("account_id", F.lit(i + 1)), F.get("uploads", F.lit(i))).alias("path"),
            ),
        )
        for i in range(4)
    ]
    content_base = _last_id(contents, "content_id")
    return NewPosts(
        placed.select(
            "post_id", "account_id", F.col("postTitle").alias("title"), at.alias("posted_at"),
            F.lit(0).alias("visibility"), F.lit(0).alias("deleted"),
        ),
        placed.select("post_id", F.explode(F.array(*content)).alias("c")).select(
            _next(content_base, F.col("c.no")).alias("content_id"), "post_id", F.col("c.text").alias("text")
        ),
        placed.select(F.explode(F.array(*file)).alias("m")).where(F.col("m").isNotNull()).select(
            _next(_last_id(media, "media_id"), F.col("m.no")).alias("media_id"),
            _next(content_base, F.col("m.content_no")).alias("content_id"),
            F.col("m.path").alias("path"),
        ),
    )


def add_comments(forms: DataFrame, comment: DataFrame) -> DataFrame:
    """New comments (seq, channel, listing_id, author_id, content) as rows, not deleted."""
    return assign_ids(forms, comment, "comment_id", "seq", per_channel=True).select(
        "channel", "comment_id", "listing_id", "author_id", "content", F.lit(0).alias("deleted")
    )


def send_dms(forms: DataFrame, messages: DataFrame, at: Column) -> DataFrame:
    """New messages (seq, receiver_id, sender_id, content) as rows without media, not deleted."""
    return assign_ids(forms, messages, "dm_id", "seq").select(
        "dm_id", "receiver_id", "sender_id", "content", F.lit(None).cast("string").alias("media"), at.alias("sent_at"),
        F.lit(0).alias("deleted"),
    )


def apply_updates(base: DataFrame, changes: DataFrame, key: list[str], cols: list[str], order: str = "seq") -> DataFrame:
    """Set ``cols`` of each changed row to its latest change; a null in a change is stored as null."""
    latest = changes.groupBy(*key).agg(F.max_by(F.struct(*cols), order).alias("_new"))
    changed = F.col("_new").isNotNull()
    return base.join(latest, key, "left").select(
        *[F.when(changed, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in base.columns]
    )


PROFILE = ["account_name", "phone", "children"]
ADDRESS = ["postal_code", "prefecture", "city_ward", "address_number", "building"]
EDIT = ["name", "condition", "description", "price", "shipping_payer", "shipping_estimate"]
EDIT_RENTAL = [*EDIT, "category_id", "rental_period"]


def update_profiles(accounts: DataFrame, addresses: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New name, phone and children of each account, and its new address."""
    return (
        apply_updates(accounts, changes, ["account_id"], PROFILE),
        apply_updates(addresses, changes, ["account_id"], ADDRESS),
    )


def edit_listings(
    listings: DataFrame, category_status: DataFrame, changes: DataFrame, channel: str
) -> tuple[DataFrame, DataFrame]:
    """Edits of one channel. A sale's category changes in the category table only, a rental's in both."""
    cols = EDIT if channel == "sale" else EDIT_RENTAL
    own = changes.where(F.col("channel") == channel)
    return (
        apply_updates(listings, own, LISTING, cols),
        apply_updates(category_status, own, LISTING, ["category_id"]),
    )


def replace_photos(photos: DataFrame, uploads: DataFrame) -> DataFrame:
    """The last upload of a listing (channel, listing_id, seq, path) replaces every photo it has."""
    return apply_updates(photos, uploads, LISTING, ["path"])


def replace_icons(accounts: DataFrame, uploads: DataFrame) -> DataFrame:
    """The last uploaded icon (account_id, seq, icon) of each account."""
    return apply_updates(accounts, uploads, ["account_id"], ["icon"])


def category_drift(listings: DataFrame, category_status: DataFrame) -> DataFrame:
    """Listings whose own category differs from the one in the category table."""
    stored = category_status.select(*LISTING, F.col("category_id").alias("status_category_id"))
    return (
        listings.select(*LISTING, "category_id")
        .join(stored, LISTING)
        .where(~F.col("category_id").eqNullSafe(F.col("status_category_id")))
    )
