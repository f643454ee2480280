"""The registered queries: every operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import catalog, ledger, posts, quality, settlement, social, writes
from ..session import stored, work_dir
from ..sources.driver import AT, DriverViews
from ..sources.tables import catalog as union
from ..sources.tables import append, commit, committed, for_key, for_listing, load_tables, unmarketplace
from ..streaming import jobs

V = DriverViews
c = F.col

# Words looked up by the keyword query; wildcard terms follow LIKE.
KEYWORDS = ["ring", "blue", "e w", "Z", ""]
WILDCARDS = ["r_d", "b%t", "100%", "e\\w"]


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays as comma-joined text, the form in which the site's queries return them."""
    return df.withColumns({name: F.array_join(name, ",") for name in columns})


def _whole(df: DataFrame, *columns: str) -> DataFrame:
    """Points as 64-bit numbers, which hold everything in the test tables."""
    return df.withColumns({name: c(name).cast("bigint") for name in columns})


def _errors(df: DataFrame) -> DataFrame:
    """The error map as sorted text ``field:code,...``."""
    entries = F.transform(F.map_entries("errors"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return df.withColumn("errors", F.array_join(F.array_sort(entries), ","))


def _shown(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def _now() -> Column:
    return F.lit(AT).cast("timestamp_ntz")


# ---- listings ----------------------------------------------------------------------------------


def browse(v: V) -> DataFrame:
    return catalog.browse(v.listing(), v.photo())


def visible(v: V) -> DataFrame:
    return catalog.visible(browse(v))


def catalog_union(v: V) -> DataFrame:
    """Split the listings into the site's twin tables and put them together again."""
    twins = unmarketplace({"listing": v.listing()})
    rows = union(twins["t_sale"], twins["t_rental"])
    return rows.withColumns({
        "listing_id": c("listing_id").cast("bigint"), "seller_id": c("seller_id").cast("bigint"),
        "price": tx.whole_yen(c("price")), "listed_at": _shown(c("listed_at")),
    })


def lookup_listing(v: V) -> DataFrame:
    """One listing's page; the key reaches every scan."""
    one = for_listing({"listing": v.listing(), "photo": v.photo()}, "sale", 7)
    return _joined(catalog.item_detail(one["listing"], one["photo"], v.category()), "photos")


def lookup_account(v: V) -> DataFrame:
    one = for_key({"account": v.account(), "address": v.address()}, account_id=7)
    return social.account_profile(one["account"], one["address"])


def lookup_seller(v: V) -> DataFrame:
    one = for_key({"listing": v.listing()}, seller_id=7)
    return catalog.seller(one["listing"], v.account())


def lookup_post(v: V) -> DataFrame:
    return for_key({"content": posts.post_html(v.post_content())}, post_id=7)["content"]


def keyword_search(v: V) -> DataFrame:
    rows = v.listing().select("channel", "listing_id", "name")
    return catalog.keyword_search(rows, KEYWORDS)


def keyword_wildcards(v: V) -> DataFrame:
    rows = v.listing().select("channel", "listing_id", "name")
    return catalog.keyword_search(rows, WILDCARDS, wildcards=True)


def keyword_terms(v: V) -> DataFrame:
    rows = v.listing().select("channel", "listing_id", "name")
    return catalog.keyword_search(rows, v.term()).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def _facet(v: V, tags: list[Column]) -> DataFrame:
    return catalog.facet(v.listing().select("channel", "listing_id", "category_id", "condition", "price"), tags).select(
        "channel", "listing_id", "tag"
    )


def facet_category(v: V) -> DataFrame:
    return _facet(v, catalog.category_tags())


def facet_condition(v: V) -> DataFrame:
    return _facet(v, catalog.condition_tags())


def facet_price(v: V) -> DataFrame:
    return _facet(v, catalog.price_tags())


def facet_index(v: V) -> DataFrame:
    return catalog.facet_index(v.listing()).select("channel", "listing_id", "tag")


def facet_counts(v: V) -> DataFrame:
    return catalog.facet_counts(v.listing())


def item_detail(v: V) -> DataFrame:
    return _joined(catalog.item_detail(v.listing(), v.photo(), v.category()), "photos")


def photo_slots(v: V) -> DataFrame:
    return catalog.photo_slots(v.listing(), v.photo())


def comments(v: V) -> DataFrame:
    return catalog.comments(v.comment(), v.account())


def comments_live(v: V) -> DataFrame:
    return catalog.comments(v.comment(), v.account(), only_live=True)


def comment_counts(v: V) -> DataFrame:
    return catalog.comment_counts(v.comment())


def seller(v: V) -> DataFrame:
    return catalog.seller(v.listing(), v.account())


def storefront(v: V) -> DataFrame:
    return catalog.storefront(v.listing(), v.photo())


def viewer_action(v: V) -> DataFrame:
    return catalog.viewer_action(v.viewer_pair(), v.listing())


# ---- stored tables -----------------------------------------------------------------------------


def stored_sales(v: V) -> DataFrame:
    """The sales written as a stored table and loaded with its schema."""
    folder = work_dir(v.spark)
    unmarketplace({"listing": v.listing()})["t_sale"].write.parquet(f"{folder}/t_sale")
    return load_tables(v.spark, folder, ["t_sale"])["t_sale"].select("saleId", "productName", "listingStatus")


def appended_comments(v: V) -> DataFrame:
    """The comments appended in three batches, the second of which runs twice."""
    rows, path = unmarketplace({"comment": v.comment()})["t_saleComment"], f"{work_dir(v.spark)}/t_saleComment"
    for batch in (0, 1, 1, 2):
        append(rows.where(F.pmod(F.xxhash64("saleCommentId"), F.lit(3)) == batch), path, batch)
    return v.spark.read.parquet(path).select("saleCommentId", "saleId", "productCommentContent")


def committed_tables(v: V) -> DataFrame:
    """Accounts and addresses committed together, then the accounts again with new names."""
    root, account = work_dir(v.spark), v.account().select("account_id", "account_name")
    commit(v.spark, root, {"account": account, "address": v.address().select("account_id", "postal_code")}, 1)
    commit(v.spark, root, {"account": account.withColumn("account_name", F.concat("account_name", F.lit("!")))}, 2)
    now = committed(v.spark, root)
    return now["account"].join(now["address"], "account_id", "left")


def split_lists(v: V) -> DataFrame:
    items = tx.split_list(c("text"))
    return v.table("conversations").select("conv_id", "turn", F.size(items).alias("n"), F.get(items, F.lit(0)).alias("first_item"))


# ---- accounts, follows, messages ---------------------------------------------------------------


def account_profile(v: V) -> DataFrame:
    return social.account_profile(v.account(), v.address())


def follow_now(v: V) -> DataFrame:
    return social.follow_now(v.follow_log())


def follow_add(v: V) -> DataFrame:
    """Every event asks for an edge; the ones already in the graph are left out."""
    wanted = v.dm_form().select("seq", c("receiver_id").alias("followed_id"), c("sender_id").alias("follower_id"))
    return writes.assign_ids(social.follow_add(wanted, v.follow()), v.follow(), "follow_id", "seq")


def follow_remove(v: V) -> DataFrame:
    gone = v.follow_log().where(c("action") == "unfollow")
    return social.follow_remove(v.follow_log().select("followed_id", "follower_id").distinct(), gone)


def follow_counts(v: V) -> DataFrame:
    return social.follow_counts(v.follow())


def following(v: V) -> DataFrame:
    return social.following(v.follow(), v.account())


def followers(v: V) -> DataFrame:
    return social.followers(v.follow(), v.account())


def follow_flag(v: V) -> DataFrame:
    return social.follow_flag(v.candidates(), v.follow())


def dm_threads(v: V) -> DataFrame:
    return social.dm_threads(v.dm(), v.account())


def dm_sides(v: V) -> DataFrame:
    return social.dm_sides(dm_threads(v))


# ---- posts -------------------------------------------------------------------------------------


def post_feed(v: V) -> DataFrame:
    return posts.post_feed(v.post(), v.account())


def post_feed_live(v: V) -> DataFrame:
    return posts.post_feed(v.post(), v.account(), only_live=True)


def post_detail(v: V) -> DataFrame:
    pages = posts.post_detail(v.post(), v.account(), v.post_content(), v.post_media())
    return _joined(pages, "content_ids", "texts", "media_ids", "media").withColumn("posted_at", _shown(c("posted_at")))


def post_html(v: V) -> DataFrame:
    return posts.post_html(v.post_content())


def _new_posts(v: V) -> writes.NewPosts:
    forms, _ = quality.split(stored(quality.validate(v.post_form(), quality.post_rules())))
    return writes.publish_posts(forms, v.post(), v.post_content(), v.post_media(), _now())


def post_publish(v: V) -> DataFrame:
    return _new_posts(v).contents


def post_publish_posts(v: V) -> DataFrame:
    return _new_posts(v).posts.withColumn("posted_at", _shown(c("posted_at")))


def post_publish_media(v: V) -> DataFrame:
    return _new_posts(v).media


# ---- points and purchases ----------------------------------------------------------------------


def points_ledger(v: V) -> DataFrame:
    return _whole(ledger.points_ledger(v.ledger_event()), "amount", "balance")


def points_ledger_opening(v: V) -> DataFrame:
    """The ledger on top of the balances the accounts start with; opening rows have no seq."""
    return _whole(ledger.points_ledger(v.ledger_event(), v.account()), "amount", "balance")


def points_balance(v: V) -> DataFrame:
    return _whole(ledger.points_balance(v.account(), ledger.points_ledger(v.ledger_event())), "points")


def points_commands(v: V) -> DataFrame:
    return _whole(ledger.points_commands(v.search()), "amount")


def _settled(v: V, mode: str = "as_is") -> settlement.Settlement:
    return settlement.settle(v.purchase(), v.listing(), v.transaction(), mode)


def settle_transactions(v: V) -> DataFrame:
    return _settled(v).transactions


def settle_first_wins(v: V) -> DataFrame:
    return _settled(v, "first_wins").transactions


def settle_events(v: V) -> DataFrame:
    return _settled(v).events


def settle_deltas(v: V) -> DataFrame:
    return _whole(ledger.point_deltas(_settled(v).events), "delta")


def settle_rejects(v: V) -> DataFrame:
    return _settled(v).rejects


def settle_listings(v: V) -> DataFrame:
    return _settled(v).listing_updates


def listing_state(v: V) -> DataFrame:
    return settlement.listing_state(v.listing_event())


def sales_report(v: V) -> DataFrame:
    return settlement.sales_report(_settled(v).transactions, v.listing())


def category_drift(v: V) -> DataFrame:
    return writes.category_drift(v.listing(), v.category_status())


# ---- writes ------------------------------------------------------------------------------------


def assign_ids(v: V) -> DataFrame:
    """Orders numbered after the address ids; passes 99999 at the larger scales."""
    return writes.assign_ids(
        v.table("orders").select("o_orderkey"), v.address(), "new_id", "o_orderkey", existing_id="address_id"
    )


def _registered(v: V) -> tuple[DataFrame, DataFrame]:
    good, _ = quality.split(stored(quality.validate_registrations(v.registration(), v.account())))
    return writes.register_accounts(good, v.account(), v.address())


def register(v: V) -> DataFrame:
    return _registered(v)[0].withColumn("birthday", c("birthday").cast("string"))


def register_addresses(v: V) -> DataFrame:
    return _registered(v)[1]


def _listed(v: V) -> writes.NewListings:
    forms, _ = quality.split(stored(quality.validate_listings(v.listing_form())))
    return writes.list_items(forms, v.listing(), v.category_status(), v.photo(), _now())


def list_item(v: V) -> DataFrame:
    return _listed(v).listings.withColumns({"price": tx.whole_yen(c("price")), "listed_at": _shown(c("listed_at"))})


def list_item_category(v: V) -> DataFrame:
    return _listed(v).category_status


def list_item_photos(v: V) -> DataFrame:
    return _listed(v).photos


def add_comment(v: V) -> DataFrame:
    return writes.add_comments(v.comment_form(), v.comment())


def send_dm(v: V) -> DataFrame:
    return writes.send_dms(v.dm_form(), v.dm(), _now()).withColumn("sent_at", _shown(c("sent_at")))


def _profile_changes(v: V) -> DataFrame:
    return quality.split(quality.validate_profile_changes(v.profile_change(), v.account()))[0]


def update_profile(v: V) -> DataFrame:
    return writes.update_profiles(v.account(), v.address(), _profile_changes(v))[0]


def update_address(v: V) -> DataFrame:
    return writes.update_profiles(v.account(), v.address(), _profile_changes(v))[1]


def valid_profile(v: V) -> DataFrame:
    return _errors(quality.validate_profile_changes(v.profile_change(), v.account())).select("seq", "account_id", "errors")


def _edited(v: V, channel: str) -> tuple[DataFrame, DataFrame]:
    return writes.edit_listings(v.listing(), v.category_status(), quality.split(_checked_edits(v))[0], channel)


def _checked_edits(v: V) -> DataFrame:
    return quality.validate_edits(v.listing_edit())


def valid_edit(v: V) -> DataFrame:
    return _errors(_checked_edits(v)).select("seq", tx.whole_yen(c("price")).alias("price"), "errors")


def edit_sale(v: V) -> DataFrame:
    return _edited(v, "sale")[0].withColumns({"price": tx.whole_yen(c("price")), "listed_at": _shown(c("listed_at"))})


def edit_rental(v: V) -> DataFrame:
    return _edited(v, "rental")[0].withColumns({"price": tx.whole_yen(c("price")), "listed_at": _shown(c("listed_at"))})


def edit_sale_category(v: V) -> DataFrame:
    return _edited(v, "sale")[1]


def edit_rental_category(v: V) -> DataFrame:
    return _edited(v, "rental")[1]


def replace_photos(v: V) -> DataFrame:
    return writes.replace_photos(v.photo(), v.photo_upload())


def replace_icon(v: V) -> DataFrame:
    good, _ = quality.split(quality.validate(v.icon_upload(), quality.icon_rules()))
    uploads = good.withColumn("icon", F.concat(F.lit("./static/upload/"), c("account_id").cast("string"), F.lit("_"), c("file")))
    return writes.replace_icons(v.account(), uploads).select(
        "account_id", "icon", tx.public_path(c("icon")).alias("public_icon")
    )


# ---- checks and masks --------------------------------------------------------------------------


def valid_registration(v: V) -> DataFrame:
    return _errors(quality.validate_registrations(v.registration(), v.account())).select("seq", "errors")


def valid_listing(v: V) -> DataFrame:
    checked = _errors(quality.validate_listings(v.listing_form()))
    price = tx.parse_price(c("sellingPrice"))
    return checked.select(
        "seq", "errors", tx.whole_yen(price).alias("price"),
        tx.file_extension(F.get("uploads", F.lit(1))).alias("extension2"),
        tx.count_filled(c("uploads")).cast("bigint").alias("n_uploads"),
    )


def valid_post(v: V) -> DataFrame:
    return _errors(quality.validate(v.post_form(), quality.post_rules())).select("seq", "errors")


def normalise(v: V) -> DataFrame:
    """All input masks over registration texts."""
    return v.registration().select(
        "seq",
        tx.digits_only(c("phone")).alias("phone"),
        tx.postal_mask(F.concat(c("postal_code"), c("seq").cast("string"))).alias("postal_code"),
        tx.postal_mask(c("seq").cast("string")).alias("postal_part"),
        tx.date_mask(c("birthday")).alias("birthday"),
        tx.date_mask(c("seq").cast("string")).alias("date_part"),
        tx.price_mask(c("postal_code")).alias("price"),
        tx.price_mask(c("name")).alias("no_price"),
    )


def postal_enrich(v: V) -> DataFrame:
    return quality.postal_enrich(v.address().select("account_id", "postal_code"), v.postal())


# ---- streams -----------------------------------------------------------------------------------


def stream_points(v: V) -> DataFrame:
    return _whole(jobs.run_points(v), "points")


def stream_points_opening(v: V) -> DataFrame:
    return _whole(jobs.run_points_opening(v), "points")


def stream_listing_state(v: V) -> DataFrame:
    return jobs.run_listing_state(v)


def stream_settle(v: V) -> DataFrame:
    return jobs.run_settlement(v)["transactions"]


def stream_settle_events(v: V) -> DataFrame:
    return jobs.run_settlement(v)["events"]


def stream_settle_listings(v: V) -> DataFrame:
    return jobs.run_settlement(v)["listing_updates"].distinct()


def stream_settle_rejects(v: V) -> DataFrame:
    return jobs.run_settlement(v)["rejects"]


def stream_follow(v: V) -> DataFrame:
    return jobs.run_follow(v)


def stream_registration(v: V) -> DataFrame:
    return _errors(jobs.run_registration(v)).select("seq", "errors")


def stream_window_counts(v: V) -> DataFrame:
    return jobs.run_window_counts(v)


def stream_window_late(v: V) -> DataFrame:
    return jobs.run_window_late(v)


ALL: list[Callable[[V], DataFrame]] = [
    browse, visible, catalog_union, lookup_listing, lookup_account, lookup_seller, lookup_post, keyword_search, keyword_wildcards, keyword_terms, facet_category, facet_condition,
    facet_price, facet_index, facet_counts, item_detail, photo_slots, comments, comments_live, comment_counts, seller,
    storefront, viewer_action, account_profile, follow_now, follow_add, follow_remove, follow_counts, following,
    followers, follow_flag, dm_threads, dm_sides, post_feed, post_feed_live, post_detail, post_html, post_publish,
    post_publish_posts, post_publish_media, points_ledger, points_ledger_opening, points_balance, points_commands,
    settle_transactions, settle_first_wins, settle_events, settle_deltas, settle_rejects, settle_listings,
    listing_state, sales_report, category_drift, assign_ids, register, register_addresses, list_item,
    list_item_category, list_item_photos, add_comment, send_dm, update_profile, update_address, valid_profile,
    valid_edit, edit_sale, edit_rental, edit_sale_category, edit_rental_category, replace_photos, replace_icon,
    valid_registration, valid_listing, valid_post, normalise, postal_enrich, stream_points, stream_listing_state,
    stream_settle, stream_settle_events, stream_settle_listings, stream_settle_rejects, stream_points_opening, stream_follow, stream_registration, stream_window_counts,
    stream_window_late, stored_sales, appended_comments, committed_tables, split_lists,
]


def _entry(query: Callable[[V], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(DriverViews(spark, sf_dir))


QUERIES = {query.__name__: _entry(query) for query in ALL}
