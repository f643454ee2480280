"""Marketplace-shaped views over the TPC-H-like test tables.

The tables of the marketplace itself are not among the test data, so each view derives its rows
from a whole test table. Only columns are derived; no rows are left out to save work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import postal_dimension
from ..operators.social import follow_now
from ..schemas import (
    CATEGORIES, CONDITIONS, GENDERS, LISTED, PAY_CARD, PAY_POINTS, PREFECTURES, RENTAL_PERIODS, SHIPPING_ESTIMATES,
    SHIPPING_PAYERS, SOLD, UPLOAD_DIR,
)

AT = "2024-01-01 00:00:00"  # the time of writing used by queries that add rows


def _pick(values: list[str], key: str) -> str:
    """SQL: one of the values by the key's remainder."""
    listed = ", ".join(f"'{v}'" for v in values)
    return f"get(array({listed}), int({key} % {len(values)}))"


def _channel(listing_id: str) -> str:
    return f"if({listing_id} % 3 = 0, 'rental', 'sale') AS channel"


K = "bigint(get_json_object(props, '$.k'))"
ORDER = [_channel("o_orderkey"), "o_orderkey AS listing_id"]


def _event(n_listings: int) -> list[str]:
    """The listing an event is about: three events in a row share one, spread over all listings."""
    key = _about(n_listings)
    return [_channel(key), f"{key} AS listing_id"]


def _about(n_listings: int) -> str:
    return f"(event_id div 3 * 31) % {n_listings}"


YEN = "bigint(floor(o_totalprice / 50))"


class DriverViews:
    """Lazy views by name, e.g. ``DriverViews(spark, dir).listing()``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def size(self, name: str) -> int:
        """Rows of a test table, from its file footers."""
        return max(1, self.spark.read.parquet(f"{self.dir}/{name}.parquet").count())

    @property
    def event(self) -> list[str]:
        return _event(self.size("orders"))

    def events(self, where: str) -> DataFrame:
        return self.table("events").where(where)

    # ---- stored tables ------------------------------------------------------------------------

    def account(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey AS account_id", "c_name AS account_name",
            "concat('./static/images/', c_mktsegment, '.jpg') AS icon",
            "concat(lower(c_name), '@example.com') AS email",
            "format_string('%010d', c_custkey * 7919) AS phone", "int(c_custkey % 3) AS children",
            "bigint(floor(c_acctbal)) AS points",
        )

    def address(self) -> DataFrame:
        code = "format_string('%07d', bigint(c_nationkey) * 10007)"
        return self.table("customer").selectExpr(
            "format_string('%05d', c_custkey + 1) AS address_id", "c_custkey AS account_id",
            f"""CASE WHEN c_custkey % 9 = 4 THEN '' WHEN c_custkey % 9 = 5 THEN '9999999'
                ELSE concat(substring({code}, 1, 3), '-', substring({code}, 4, 4)) END AS postal_code""",
            f"{_pick(PREFECTURES, 'c_custkey')} AS prefecture", "c_mktsegment AS city_ward",
            "string(c_nationkey) AS address_number", "if(c_custkey % 4 = 0, c_name, NULL) AS building",
        )

    def category(self) -> DataFrame:
        rows = ", ".join(f"('{key}', '{name}')" for key, name in CATEGORIES.items())
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS t(category_id, category_name)")

    def listing(self) -> DataFrame:
        orders = self.table("orders").selectExpr("*", f"o_orderkey % {self.size('part')} AS p_partkey")
        return orders.join(self.table("part").select("p_partkey", "p_name", "p_type"), "p_partkey").selectExpr(
            *ORDER, "o_custkey AS seller_id", "concat('0000', substring(o_orderpriority, 1, 1)) AS category_id",
            "p_name AS name", f"{_pick(CONDITIONS, 'o_orderkey')} AS condition", "p_type AS description",
            "CAST(floor(o_totalprice / 50) AS DECIMAL(12,2)) AS price",
            f"{_pick(SHIPPING_PAYERS, 'o_orderkey')} AS shipping_payer",
            f"{_pick(SHIPPING_ESTIMATES, 'o_orderkey')} AS shipping_estimate",
            f"if(o_orderkey % 3 = 0, {_pick(RENTAL_PERIODS, 'o_orderkey')}, NULL) AS rental_period",
            "o_orderdate AS listed_at", f"if(o_orderstatus = 'F', '{SOLD}', '{LISTED}') AS status",
            "int(o_orderkey % 17 = 0) AS deleted",
        )

    def category_status(self) -> DataFrame:
        return self.table("orders").selectExpr(
            *ORDER, "format_string('%05d', o_orderkey + 1) AS status_id",
            "if(o_orderkey % 10 = 3, '00001', concat('0000', substring(o_orderpriority, 1, 1))) AS category_id",
        )

    def photo(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            _channel("l_orderkey"), "l_partkey * 100 + l_linenumber AS photo_id", "l_orderkey AS listing_id",
            f"""if(l_partkey % 31 = 0, ' ', concat('{UPLOAD_DIR}/', l_partkey, '_', l_linenumber, '.jpg')) AS path""",
        )

    def comment(self) -> DataFrame:
        return self.comment_form().selectExpr(
            "channel", "seq AS comment_id", "listing_id", "author_id", "content", "int(seq % 10 = 3) AS deleted"
        )

    def follow(self) -> DataFrame:
        number = "format_string('%05d', follower_id * 100 + followed_id) AS follow_id"
        return follow_now(self.follow_log()).selectExpr("*", number)

    def transaction(self) -> DataFrame:
        """Every listing sold before has one transaction."""
        return self.table("orders").where("o_orderstatus = 'F'").selectExpr(
            _channel("o_orderkey"), "format_string('%05d', o_orderkey + 1) AS transaction_id", "o_orderkey AS listing_id",
            "o_custkey AS buyer_id", f"'{PAY_CARD}' AS payment_method", "0 AS status",
        )

    def dm(self) -> DataFrame:
        return self.dm_form().selectExpr(
            "seq AS dm_id", "receiver_id", "sender_id", "content", "string(NULL) AS media", "ts AS sent_at",
            "int(seq % 10 = 0) AS deleted",
        )

    def post(self) -> DataFrame:
        return self.table("conversations").select("conv_id").distinct().selectExpr(
            "conv_id AS post_id", f"conv_id % {self.size('customer')} AS account_id", "concat('post ', conv_id) AS title",
            f"timestamp_ntz'{AT}' + make_dt_interval(0, 0, int(conv_id)) AS posted_at",
            "int(conv_id % 5 = 0) AS visibility", "int(conv_id % 7 = 0) AS deleted",
        )

    def post_content(self) -> DataFrame:
        return self.table("conversations").selectExpr("conv_id * 1000 + turn AS content_id", "conv_id AS post_id", "text")

    def post_media(self) -> DataFrame:
        return self.table("conversations").where("role = 'assistant'").selectExpr(
            "conv_id * 1000 + turn AS media_id", "conv_id * 1000 + turn AS content_id",
            f"concat('{UPLOAD_DIR}/', conv_id * 1000 + turn, '.jpg') AS path",
        )

    def postal(self) -> DataFrame:
        """The postal table, read from replies in the shape of the address service."""
        nations = self.table("nation").withColumnRenamed("n_regionkey", "r_regionkey")
        replies = nations.join(self.table("region"), "r_regionkey").selectExpr(
            """to_json(struct(array(struct(
                format_string('%07d', bigint(n_nationkey) * 10007) AS zipcode, r_name AS address1, n_name AS address2,
                concat(n_name, '-', n_nationkey) AS address3), struct(
                format_string('%07d', bigint(n_nationkey) * 10007) AS zipcode, 'A' AS address1, 'second' AS address2,
                'result' AS address3)) AS results)) AS body"""
        )
        return postal_dimension(replies)

    # ---- change feeds -------------------------------------------------------------------------

    def comment_form(self) -> DataFrame:
        return self.events("event_type = 'view'").selectExpr(
            "event_id AS seq", *self.event, "user_id AS author_id", "concat('comment ', props) AS content"
        )

    def follow_log(self) -> DataFrame:
        return self.events("event_type IN ('click', 'error')").selectExpr(
            "event_id AS seq", f"{K} AS followed_id", "user_id AS follower_id",
            "if(event_type = 'click', 'follow', 'unfollow') AS action",
        )

    def candidates(self) -> DataFrame:
        return self.table("events").selectExpr("user_id AS viewer_id", f"{K} AS account_id").distinct()

    def ledger_event(self) -> DataFrame:
        return self.events("event_type <> 'error'").selectExpr(
            "user_id AS account_id", "event_id AS seq",
            """CASE event_type WHEN 'signup' THEN 'reset' WHEN 'click' THEN 'grant' WHEN 'view' THEN 'credit'
               WHEN 'purchase' THEN 'debit' END AS kind""",
            """bigint(CASE event_type WHEN 'signup' THEN 0 WHEN 'click' THEN floor(value * 1000000)
               ELSE floor(value) END) AS amount""",
        )

    def search(self) -> DataFrame:
        n = "bigint(floor(value * 1000000))"
        return self.table("events").selectExpr(
            "event_id AS seq", "user_id AS account_id",
            f"""CASE WHEN event_type = 'signup' THEN 'pointReset'
                WHEN event_type <> 'click' THEN concat('search ', props)
                WHEN event_id % 5 = 0 THEN concat('pointGet', {n}, chr(10))
                WHEN event_id % 5 = 1 THEN concat('pointGet', translate({n}, '0123456789', '０１２３４５６７８９'))
                WHEN event_id % 5 = 2 THEN concat('pointGet', repeat('9', 45))
                ELSE concat('pointGet', {n}) END AS search_box""",
        )

    def purchase(self) -> DataFrame:
        listed = self.events("event_type = 'purchase'").selectExpr(
            "*", f"if(event_id % 40 = 7, -event_id, {_about(self.size('orders'))}) AS listing_id"
        )
        return listed.selectExpr(
            "event_id AS seq", _channel("listing_id"), "listing_id", "user_id AS account_id",
            f"if(event_id % 2 = 0, '{PAY_POINTS}', '{PAY_CARD}') AS payMethod",
            "if(event_id % 70 = 11, '99999999999', string(event_id * 37 % 9700 + 300)) AS sellingPrice",
            "if(event_id % 50 = 12, 'abc', string(bigint(floor(value * 100)))) AS point",
        )

    def listing_event(self) -> DataFrame:
        orders = self.table("orders").selectExpr(*ORDER, "if(o_orderstatus = 'F', 'sold', 'listed') AS kind")
        later = self.events("event_type IN ('purchase', 'error')").selectExpr(
            *self.event, "if(event_type = 'purchase', 'sold', 'deleted') AS kind"
        )
        return orders.unionByName(later)

    def dm_form(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id AS seq", "ts", f"{K} AS receiver_id", "user_id AS sender_id",
            "concat(event_type, ' ', event_id) AS content",
        )

    def post_form(self) -> DataFrame:
        """Four turns of a conversation to a form."""
        texts = ", ".join(f"coalesce(max(if(turn % 4 = {i}, text, NULL)), '')" for i in range(4))
        files = ", ".join(
            f"coalesce(max(if(turn % 4 = {i} AND role = 'assistant', concat('img', turn, '.png'), NULL)), '')"
            for i in range(4)
        )
        rows = self.table("conversations").selectExpr(
            "bigint(conv_id * 1000 + turn div 4) AS seq", f"conv_id % {self.size('customer')} AS account_id",
            """CASE WHEN conv_id % 11 = 3 THEN '' WHEN conv_id % 13 = 4 THEN repeat('長', 41)
               ELSE concat('post ', conv_id) END AS postTitle""", "turn", "role", "text",
        )
        grouped = rows.groupBy("seq", "account_id", "postTitle")
        return grouped.agg(F.expr(f"array({texts})").alias("contents"), F.expr(f"array({files})").alias("uploads"))

    def registration(self) -> DataFrame:
        """One form per customer with faults, clashing names and clashing e-mails spread over them."""
        password = """CASE WHEN c_custkey % 7 = 2 THEN 'onlyletters' WHEN c_custkey % 7 = 3 THEN 'abc1'
                      ELSE concat('passw0rd', c_custkey) END"""
        return self.table("customer").selectExpr(
            "c_custkey AS seq",
            """CASE WHEN c_custkey % 10 = 8 THEN concat(lower(c_name), '@example.com')
               ELSE concat('mail', if(c_custkey % 10 = 6, c_custkey - 1, c_custkey), '@example.com') END AS email""",
            f"{password} AS password",
            f"if(c_custkey % 11 = 4, 'different1', {password}) AS password_confirm",
            "if(c_custkey % 13 = 5, 'Yamada', '山田') AS name", "'花子' AS name_first", "'ヤマダ' AS name_kana",
            "if(c_custkey % 17 = 6, 'はなこ', 'ハナコ') AS name_kana_first",
            """CASE WHEN c_custkey % 10 = 3 THEN c_name
               ELSE concat('user', if(c_custkey % 10 = 1, c_custkey - 1, c_custkey)) END AS username""",
            """CASE WHEN c_custkey % 19 = 7 THEN '2024/02/30' WHEN c_custkey % 19 = 8 THEN '24/01/05'
               ELSE concat_ws('/', c_custkey % 50 + 1970, c_custkey % 12 + 1, c_custkey % 28 + 1) END AS birthday""",
            f"if(c_custkey % 23 = 9, '不明', {_pick(GENDERS, 'c_custkey')}) AS gender",
            "concat('090-', format_string('%04d', c_custkey % 10000)) AS phone",
            "if(c_custkey % 29 = 10, '5', string(c_custkey % 3)) AS children_count",
            "format_string('%07d', c_custkey * 37 % 10000000) AS postal_code",
            f"""CASE WHEN c_custkey % 31 = 11 THEN 'atlantis' WHEN c_custkey % 31 = 12 THEN ''
                ELSE {_pick(PREFECTURES, 'c_custkey')} END AS address""",
            "c_mktsegment AS city", "string(c_nationkey) AS street", "'' AS building",
        )

    def listing_form(self) -> DataFrame:
        rows = self.table("orders").selectExpr("*", f"{YEN} AS yen")
        return rows.selectExpr(
            "o_orderkey AS seq", _channel("o_orderkey"), "o_custkey AS account_id",
            """CASE WHEN o_orderkey % 37 = 5 THEN '' WHEN o_orderkey % 41 = 6 THEN repeat('長', 41)
               ELSE concat('item ', o_orderkey) END AS productName""",
            f"if(o_orderkey % 61 = 1, '新品', {_pick(CONDITIONS, 'o_orderkey')}) AS productCondition",
            "o_orderpriority AS productDescription",
            """CASE WHEN o_orderkey % 43 = 7 THEN 'abc' WHEN o_orderkey % 47 = 8 THEN ''
               WHEN yen >= 1000 THEN concat('¥ ', yen div 1000, ',', lpad(yen % 1000, 3, '0'))
               ELSE concat('¥ ', yen) END AS sellingPrice""",
            "concat('0000', substring(o_orderpriority, 1, 1)) AS categoryId",
            f"{_pick(SHIPPING_PAYERS, 'o_orderkey')} AS shippingPayer",
            f"if(o_orderkey % 67 = 2, 'いつか', {_pick(SHIPPING_ESTIMATES, 'o_orderkey')}) AS shippingEstimate",
            f"if(o_orderkey % 9 <> 3, {_pick(RENTAL_PERIODS, 'o_orderkey')}, NULL) AS rentalPeriod",
            """array(if(o_orderkey % 53 = 9, '', concat('a', o_orderkey, '.jpg')),
                     CASE WHEN o_orderkey % 59 = 10 THEN 'b.gif'
                          WHEN o_orderkey % 4 = 1 THEN concat('b', o_orderkey, '.PNG') ELSE '' END,
                     '', if(o_orderkey % 5 = 0, 'd.gif', '')) AS uploads""",
        )

    def profile_change(self) -> DataFrame:
        return self.events("event_type = 'click'").selectExpr(
            "event_id AS seq", "user_id AS account_id",
            "concat('nick', if(event_id % 8 = 0, 0, event_id)) AS account_name",
            "if(event_id % 4 <> 0, concat('080', event_id), NULL) AS phone", "int(event_id % 3) AS children",
            "format_string('%07d', event_id) AS postal_code", f"{_pick(PREFECTURES, 'event_id')} AS prefecture",
            "event_type AS city_ward", "string(event_id) AS address_number", "string(NULL) AS building",
        )

    def listing_edit(self) -> DataFrame:
        return self.events("event_type = 'error'").selectExpr(
            "event_id AS seq", *self.event, "concat('edited ', event_id) AS name",
            f"{_pick(CONDITIONS, 'event_id')} AS condition", "if(event_id % 3 <> 0, props, NULL) AS description",
            "if(event_id % 9 = 4, 'abc', concat('¥ ', format_number(floor(value * 100), 0))) AS sellingPrice",
            f"{_pick(SHIPPING_PAYERS, 'event_id')} AS shipping_payer",
            f"{_pick(SHIPPING_ESTIMATES, 'event_id')} AS shipping_estimate",
            "format_string('%05d', event_id % 4 + 1) AS category_id",
            f"{_pick(RENTAL_PERIODS, 'event_id')} AS rental_period",
        )

    def photo_upload(self) -> DataFrame:
        return self.events("event_type = 'signup'").selectExpr(
            "event_id AS seq", *self.event, f"concat('{UPLOAD_DIR}/new_', event_id, '.jpg') AS path"
        )

    def icon_upload(self) -> DataFrame:
        return self.events("event_type = 'signup'").selectExpr(
            "event_id AS seq", "user_id AS account_id",
            """CASE event_id % 6 WHEN 0 THEN concat('icon', event_id, '.bmp') WHEN 1 THEN ''
               ELSE concat('icon', event_id, '.JPG') END AS file""",
        )

    def viewer_pair(self) -> DataFrame:
        viewers = self.events("event_type = 'view'").selectExpr("user_id AS viewer_id", *self.event)
        return viewers.unionByName(self.table("orders").selectExpr("o_custkey AS viewer_id", *ORDER))

    def term(self) -> DataFrame:
        """Search terms: every word that occurs in a part name."""
        return self.table("part").selectExpr("explode(split(p_name, ' ')) AS term").distinct()
