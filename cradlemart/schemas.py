"""Table schemas, change-feed schemas and the fixed value domains."""

from __future__ import annotations

CAP = 99_999_999  # fixed value: highest balance a points grant may reach
MIN_PRICE, MAX_PRICE = 300, 9_999_999  # fixed values: price range of a new listing


# Schemas are DDL strings, as spark.read.schema and createDataFrame take them.

TABLES = {
    "t_account": (
        "accountId string, accountName string, icon string, emailAddress string, lastname string, "
        "firstname string, lastnamekana string, firstnamekana string, birthDate date, gender string, "
        "phonenumber string, numberofchildren int, points bigint"
    ),
    "t_address": (
        "addressId string, accountId string, postalCode string, prefecture string, cityWard string, "
        "addressNumber string, buildingName string"
    ),
    "t_category": ("categoryId string, categoryName string"),
    "t_sale": (
        "saleId string, accountId string, categoryId string, productName string, productCondition string, "
        "productDescription string, sellingPrice decimal(12,2), shippingPayer string, shippingEstimate string, "
        "listingDateTime timestamp, listingStatus string, deletionStatus int"
    ),
    "t_saleCategoryStatus": ("saleCategoryStatusId string, saleId string, categoryId string"),
    "t_salePhoto": ("salePhotoId string, saleId string, productPhoto string"),
    "t_saleComment": (
        "saleCommentId string, saleId string, accountId string, productCommentContent string, "
        "productCommentDeletionStatus int"
    ),
    "t_saleTransaction": (
        "saleTransactionId string, saleId string, accountId string, productPaymentMethod string, "
        "productTransactionStatus int"
    ),
    "t_rental": (
        "rentalId string, accountId string, categoryId string, rentalProductName string, "
        "rentalProductCondition string, rentalDescription string, rentalPrice decimal(12,2), "
        "rentalShippingPayer string, rentalShippingEstimate string, rentalPeriod string, "
        "rentalListingDateTime timestamp, rentalListingStatus string, rentalDeletionStatus int"
    ),
    "t_rentalCategoryStatus": ("rentalCategoryStatusId string, rentalId string, categoryId string"),
    "t_rentalPhoto": ("rentalPhotoId string, rentalId string, rentalPhoto string"),
    "t_rentalComment": (
        "rentalCommentId string, rentalId string, accountId string, rentalCommentContent string, "
        "rentalCommentDeletionStatus int"
    ),
    "t_rentalTransaction": (
        "rentalTransactionId string, rentalId string, accountId string, rentalPaymentMethod string, "
        "rentalTransactionStatus int"
    ),
    "t_follow": ("followId string, accountId string, followerId string"),
    "t_post": (
        "postId string, accountId string, postTitle string, postDateTime timestamp, postVisibilityStatus int, "
        "postDeletionStatus int"
    ),
    "t_postContent": ("postContentId string, postId string, postText string"),
    "t_postMedia": ("postMediaId string, postContentId string, postAttachedMedia string"),
    "t_directMessage": (
        "directMessageId string, accountId string, senderId string, directMessageContent string, "
        "directMessageAttachedMedia string, directSendDateTime timestamp, directMessageDeletionStatus int"
    ),
}

FEEDS = {
    "registration": (
        "seq bigint, email string, password string, password_confirm string, name string, name_first string, "
        "name_kana string, name_kana_first string, username string, birthday string, gender string, phone string, "
        "children_count string, postal_code string, address string, city string, street string, building string"
    ),
    "listing_form": (
        "seq bigint, channel string, account_id string, productName string, productCondition string, "
        "productDescription string, sellingPrice string, categoryId string, shippingPayer string, "
        "shippingEstimate string, rentalPeriod string, uploads array<string>"
    ),
    "purchase": (
        "seq bigint, channel string, listing_id string, account_id string, payMethod string, sellingPrice string, "
        "point string"
    ),
    "points_command": ("seq bigint, account_id string, search_box string"),
    "ledger_event": ("account_id string, seq bigint, kind string, amount bigint"),
    "listing_event": ("seq bigint, channel string, listing_id string, kind string"),
    "follow_action": ("seq bigint, action string, user_id string, account_id string"),
    "post_form": (
        "seq bigint, account_id string, postTitle string, contents array<string>, uploads array<string>"
    ),
    "postal": ("zipcode string, prefecture string, city string, town string"),
}

# ---- fixed values: texts the marketplace stores and shows -------------------------------------

LISTED, SOLD = "出品中", "購入済み"
PAY_CARD, PAY_POINTS = "クレジットカード", "ポイント"

CATEGORIES = {"00001": "子供服", "00002": "ベビー＆マタニティ", "00003": "育児用品", "00004": "ベビー用品"}

CONDITIONS = [
    "新品、未使用",
    "未使用に近い",
    "目立った傷や汚れなし",
    "やや傷や汚れあり",
    "傷や汚れあり",
    "全体的に状態が悪い",
]

# Facet label -> stored condition. The third label differs between the channels.
CONDITION_TAGS = {
    "新品/未使用": "新品、未使用",
    "未使用に近い": "未使用に近い",
    "目立った汚れなし": "目立った傷や汚れなし",
    "目立った傷や汚れなし": "目立った傷や汚れなし",
    "やや傷や汚れあり": "やや傷や汚れあり",
    "傷/汚れあり": "傷や汚れあり",
    "全体的に状態が悪い": "全体的に状態が悪い",
}
TAG_ONLY_IN = {"目立った汚れなし": "sale", "目立った傷や汚れなし": "rental"}

# Facet label -> (low, high), both ends inside; the last band is open: price > 5000.
PRICE_BANDS = {
    "0～1000円": (0, 1000),
    "1000～2000円": (1000, 2000),
    "2000～3000円": (2000, 3000),
    "3000～5000円": (3000, 5000),
}
PRICE_ABOVE = ("5000円以上", 5000)

SHIPPING_PAYERS = ["送料込み(出品者負担)", "着払い(購入者負担)"]
SHIPPING_ESTIMATES = ["1～2日で発送", "3～4日で発送", "5～7日で発送"]
RENTAL_PERIODS = ["1～2週", "2～3週", "3～4週", "1～3カ月", "3～6カ月", "半年以上"]
GENDERS = ["男性", "女性"]
CHILDREN = ["0", "1", "2"]
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg"]
PREFECTURES = (
    "北海道 青森県 岩手県 宮城県 秋田県 山形県 福島県 茨城県 栃木県 群馬県 埼玉県 千葉県 東京都 神奈川県 "
    "新潟県 富山県 石川県 福井県 山梨県 長野県 岐阜県 静岡県 愛知県 三重県 滋賀県 京都府 大阪府 兵庫県 "
    "奈良県 和歌山県 鳥取県 島根県 岡山県 広島県 山口県 徳島県 香川県 愛媛県 高知県 福岡県 佐賀県 長崎県 "
    "熊本県 大分県 宮崎県 鹿児島県 沖縄県"
).split()

DEFAULT_ICON = "./static/images\\default_icon.jpg"
UPLOAD_DIR = "./static/upload"
