"""Form checks as batch jobs: accepted and rejected rows with an error code per field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digits_only, file_extension, parse_birthday, parse_price
from ..schemas import (
    CATEGORIES, CHILDREN, CONDITIONS, GENDERS, IMAGE_EXTENSIONS, MAX_PRICE, MIN_PRICE, PREFECTURES, RENTAL_PERIODS,
    SHIPPING_ESTIMATES, SHIPPING_PAYERS,
)
from .claims import granted

# The forms' patterns. (?d) leaves \n as the only line end and (?U) lets \d take the digits of every script.
PASSWORD = r"(?dU)^(?=.*[a-zA-Z])(?=.*\d).{8,}$"
NAME = "(?d)^[\\u4E00-\\u9FFF\\u3040-\\u309F\\u30A0-\\u30FF]+$"
KANA = "(?d)^[\\u30A0-\\u30FF]+$"
TITLE_LENGTH = 40  # fixed value


def _fails(c: Column, pattern: str) -> Column:
    return ~F.coalesce(F.regexp_like(c, F.lit(pattern)), F.lit(False))


def _outside(c: Column, values: list[str], optional: bool = False) -> Column:
    inside = F.coalesce(c.isin(*values), F.lit(False))
    return ~(inside | (F.coalesce(c, F.lit("")) == "")) if optional else ~inside


Rules = list[tuple[str, Column]]  # (field, code or null)


def _codes(rules: Rules) -> Column:
    """Broken rules as text ``field:code,field:code``."""
    return F.concat_ws(",", *[F.concat(F.lit(f"{field}:"), code) for field, code in rules])


def _as_map(codes: Column) -> Column:
    none = F.create_map().cast("map<string,string>")
    return F.when(codes == "", none).otherwise(F.str_to_map(codes, F.lit(","), F.lit(":")))


def validate(forms: DataFrame, rules: Rules) -> DataFrame:
    """The forms with an ``errors`` map (field -> code), empty for a good form."""
    return forms.withColumn("_codes", _codes(rules)).withColumn("errors", _as_map(F.col("_codes"))).drop("_codes")


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Checked rows without and with errors."""
    clean = F.size("errors") == 0
    return checked.where(clean).drop("errors"), checked.where(~clean)


def registration_rules() -> Rules:
    """Rules of a registration that look at the form alone."""
    c = F.col
    weak = _fails(c("password"), PASSWORD)
    required = [(f, F.when(F.coalesce(c(f), F.lit("")) == "", "required")) for f in ("username", "email", "phone")]
    return [
        *required,
        ("password", F.when(weak, "weak")),
        ("password_confirm", F.when(~weak & ~c("password").eqNullSafe(c("password_confirm")), "mismatch")),
        ("name", F.when(_fails(c("name_first"), NAME) | _fails(c("name"), NAME), "script")),
        ("name_kana", F.when(_fails(c("name_kana_first"), KANA) | _fails(c("name_kana"), KANA), "script")),
        ("birthday", F.when(parse_birthday(c("birthday")).isNull(), "format")),
        ("gender", F.when(_outside(c("gender"), GENDERS), "domain")),
        ("children_count", F.when(_outside(c("children_count"), CHILDREN), "domain")),
        ("address", F.when(_outside(c("address"), PREFECTURES, optional=True), "domain")),
    ]


def first_come(claims: DataFrame, names: list[str]) -> DataFrame:
    """Rows (seq, names...) that get all their names when served in ``seq`` order, first come first served.

    A row that loses one name leaves its other names free.
    """
    rows = claims.select("seq", *names)
    wanted = F.array(*[F.concat(F.lit(f"{name} "), name) for name in names])
    asked = rows.select("seq", F.concat(F.lit("form "), "seq").alias("actor"), wanted.alias("names"))
    return rows.join(granted(asked), "seq", "left_semi")


def validate_registrations(forms: DataFrame, accounts: DataFrame) -> DataFrame:
    """Registrations with an ``errors`` map; user name and e-mail must be new to the table and the batch.

    As on the site, a name is taken only by a registration that was itself accepted. The forms'
    passwords are tested and then dropped.
    """
    names = {"username": "account_name", "email": "email"}
    own = validate(forms, registration_rules()).drop("password", "password_confirm")
    claims = own.where(F.size("errors") == 0).select("seq", *names)
    held = {}
    for field, column in names.items():
        held[field] = accounts.select(F.col(column).alias(field)).where(F.col(field).isNotNull()).distinct()
        claims = claims.join(held[field], field, "left_anti")
    winners = first_come(claims, list(names))
    checked = own
    for field in names:
        # Who has the name: an account from before the batch, or the form that got it.
        owner = held[field].withColumn(f"_{field}_since", F.lit(-(2**63))).unionByName(
            winners.select(field, F.col("seq").alias(f"_{field}_since"))
        )
        checked = checked.join(owner, field, "left")
    taken = [
        (field, F.when((F.col(f"_{field}_since") < F.col("seq")) & ~F.map_contains_key("errors", field), "taken"))
        for field in names
    ]
    more = checked.withColumn("_taken", _codes(taken))
    return more.withColumn("errors", F.map_concat("errors", _as_map(F.col("_taken")))).select(
        *[c for c in forms.columns if c not in ("password", "password_confirm")], "errors"
    )


def validate_profile_changes(changes: DataFrame, accounts: DataFrame) -> DataFrame:
    """Profile changes with an ``errors`` map: the new user name must not belong to another account.

    Names are compared as they are when a change comes in ``seq`` order: an accepted change gives
    the account's former name free. A change without a name leaves the name as it is.
    """
    asked = changes.select(
        F.col("seq").cast("bigint").alias("seq"),
        F.coalesce(F.col("account_id").cast("string"), F.concat(F.lit("change "), "seq")).alias("actor"),
        F.array("account_name").alias("names"),
    )
    held = accounts.select(F.col("account_name").alias("name"), F.col("account_id").cast("string").alias("actor"))
    accepted = granted(asked, held.where("name IS NOT NULL")).select(F.col("seq").alias("_seq"))
    taken = F.col("_seq").isNull()
    return (
        changes.join(accepted, changes["seq"] == accepted["_seq"], "left")
        .transform(validate, [("username", F.when(taken, "taken"))])
        .select(*changes.columns, "errors")
    )


def _has_file(slot: int) -> Column:
    return F.coalesce(F.get("uploads", F.lit(slot)), F.lit("")) != ""


def _bad_type(slots: range) -> Column:
    """Does one of the slots hold a file that is no image?"""
    bad = F.lit(False)
    for slot in slots:
        extension = file_extension(F.get("uploads", F.lit(slot)))
        bad = bad | (_has_file(slot) & ~F.coalesce(extension.isin(*IMAGE_EXTENSIONS), F.lit(False)))
    return bad


def validate_listings(forms: DataFrame) -> DataFrame:
    """Listing forms with an ``errors`` map. As on the site, upload slots 1 to 3 have their type checked."""
    c = F.col
    price = c("_price")
    rules = [
        ("upload", F.when(~_has_file(0), "required").when(_bad_type(range(3)), "type")),
        ("price", F.when(price.isNull(), "number").when(~price.between(MIN_PRICE, MAX_PRICE), "range")),
        (
            "name",
            F.when(F.coalesce(c("productName"), F.lit("")) == "", "required").when(
                F.length("productName") > TITLE_LENGTH, "too_long"
            ),
        ),
        ("category", F.when(_outside(c("categoryId"), list(CATEGORIES)), "domain")),
        ("condition", F.when(_outside(c("productCondition"), CONDITIONS), "domain")),
        ("shipping_payer", F.when(_outside(c("shippingPayer"), SHIPPING_PAYERS), "domain")),
        ("shipping_estimate", F.when(_outside(c("shippingEstimate"), SHIPPING_ESTIMATES), "domain")),
        (
            "rental_period",
            F.when((c("channel") == "rental") & _outside(c("rentalPeriod"), RENTAL_PERIODS), "domain"),
        ),
    ]
    return validate(forms.withColumn("_price", parse_price(c("sellingPrice"), "decimal(38,18)")), rules).drop("_price")


def validate_edits(forms: DataFrame) -> DataFrame:
    """Edit forms with their typed price (``sellingPrice``, with or without yen sign and commas) as
    ``price``, and an ``errors`` map: a price that is no number rejects the form."""
    price = parse_price(F.col("sellingPrice"), "decimal(12,2)")
    return validate(forms.withColumn("price", price), [("price", F.when(F.col("price").isNull(), "number"))]).drop("sellingPrice")


def post_rules() -> Rules:
    """Rules of a post form: title of 1 to 40 characters, images only in slots 1 to 4."""
    title = F.when(F.coalesce("postTitle", F.lit("")) == "", "required").when(
        F.length("postTitle") > TITLE_LENGTH, "too_long"
    )
    return [("upload", F.when(_bad_type(range(4)), "type")), ("title", title)]


def icon_rules() -> Rules:
    """Rule of an icon upload (account_id, seq, file): without a file nothing changes."""
    missing = F.coalesce("file", F.lit("")) == ""
    return [
        ("upload", F.when(missing, "missing").when(~file_extension(F.col("file")).isin(*IMAGE_EXTENSIONS), "type"))
    ]


POSTAL_REPLY = "results array<struct<zipcode: string, address1: string, address2: string, address3: string>>"


def postal_dimension(replies: DataFrame) -> DataFrame:
    """Postal table (zipcode, prefecture, city, town) from JSON replies in a ``body`` column: the first result of each."""
    return (
        replies.select(F.from_json("body", POSTAL_REPLY).alias("r"))
        .select(F.get("r.results", F.lit(0)).alias("a"))
        .where(F.col("a").isNotNull())
        .select(
            F.col("a.zipcode").alias("zipcode"), F.col("a.address1").alias("prefecture"),
            F.col("a.address2").alias("city"), F.col("a.address3").alias("town"),
        )
    )


def postal_enrich(rows: DataFrame, postal: DataFrame, column: str = "postal_code") -> DataFrame:
    """Add prefecture, city and town of a postal code, and ``postal_status``: ok, missing or not_found.

    Of several places with one code the first counts: by ``position`` where the postal table has
    that column, else in the order of its rows.
    """
    place = F.struct("prefecture", "city", "town")
    at = F.col("position") if "position" in postal.columns else F.monotonically_increasing_id()
    known = (
        postal.select(digits_only(F.col("zipcode")).alias("_zip"), place.alias("_place"), at.alias("_at"))
        .groupBy("_zip")
        .agg(F.min_by("_place", "_at").alias("_place"))
    )
    missing = F.coalesce(F.col(column), F.lit("")) == ""
    return (
        rows.withColumn("_zip", digits_only(F.col(column)))
        .join(known, "_zip", "left")
        .select(
            *[F.col(c) for c in rows.columns],
            F.col("_place.prefecture").alias("postal_prefecture"), F.col("_place.city").alias("postal_city"),
            F.col("_place.town").alias("postal_town"),
            F.when(missing, "missing").when(F.col("_place").isNull(), "not_found").otherwise("ok").alias("postal_status"),
        )
    )
