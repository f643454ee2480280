"""Hand-made rows in the stored schemas."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from cradlemart.schemas import LISTED, SOLD, TABLES

T0 = datetime(2024, 5, 1, 12, 0, 0)


def sale(n, seller, category, name, condition, price, status=LISTED, deleted=0):
    return (n, seller, category, name, condition, "説明", Decimal(price), "送料込み(出品者負担)", "1～2日で発送", T0, status, deleted)


def rental(n, seller, category, name, condition, price, status=LISTED, deleted=0):
    return (*sale(n, seller, category, name, condition, price)[:9], "1～2週", T0, status, deleted)


def account(n, name, points=0):
    return (n, name, f"./static/upload/{n}.png", f"{name}@example.com", "山", "花", "ヤマ", "ハナ", date(1990, 1, 2), "女性", "090", 1, points)


ROWS = {
    "t_account": [account("00001", "aki", 50), account("00002", "beni"), account("00003", "chie")],
    "t_address": [("00001", "00001", "123-4567", "東京都", "港区", "1", "")],
    "t_category": [("00001", "子供服"), ("00002", "ベビー＆マタニティ"), ("00003", "育児用品"), ("00004", "ベビー用品")],
    "t_sale": [
        sale("00001", "00001", "00001", "赤ちゃん服 100%綿", "新品、未使用", "1000.00"),
        sale("00002", "00001", "00002", "bib_set", "目立った傷や汚れなし", "5000.00", SOLD),
        sale("00003", "00002", "00009", "stroller", "傷や汚れあり", "300.90", deleted=1),
        sale("00004", "00002", "00004", "crib", "全体的に状態が悪い", "5001.00", SOLD, 1),
        sale("00005", "00002", "other", "bibXset", "未使用に近い", "99.00"),
    ],
    "t_rental": [rental("00001", "00003", "00003", "stroller", "目立った傷や汚れなし", "2000.00", SOLD)],
    "t_saleCategoryStatus": [(f"0000{i}", f"0000{i}", "00001") for i in range(1, 6)],
    "t_rentalCategoryStatus": [("00001", "00001", "00003")],
    "t_salePhoto": [
        ("00001", "00001", "p/b.jpg"), ("00002", "00001", "p/a.jpg"), ("00003", "00001", "p/a,comma.jpg"),
        ("00004", "00001", " "), ("00005", "00002", "p/c.jpg"), ("00006", "00003", "p/d.jpg"),
    ],
    "t_rentalPhoto": [("00001", "00001", "p/r.jpg")],
    "t_saleComment": [
        ("00001", "00001", "00002", "かわいい", 0), ("00002", "00001", "00099", "誰？", 0), ("00003", "00001", "00002", "消", 1),
    ],
    "t_rentalComment": [("00001", "00001", "00001", "貸して", 0)],
    "t_saleTransaction": [],
    "t_rentalTransaction": [],
    "t_follow": [("00001", "00002", "00001"), ("00002", "00001", "00002"), ("00003", "00099", "00001")],
    "t_post": [("00001", "00001", "日記", T0, 0, 0), ("00002", "00099", "隠", T0, 1, 0), ("00003", "00002", "消", T0, 0, 1)],
    "t_postContent": [
        ("00001", "00001", "同じ\n文"), ("00002", "00001", "同じ\n文"), ("00003", "00001", ""), ("00004", "00001", ""),
    ],
    "t_postMedia": [("00001", "00001", "m/1.jpg"), ("00002", "00002", "m/2.jpg")],
    "t_directMessage": [
        ("00001", "00001", "00002", "やあ", None, T0, 0),
        ("00002", "00002", "00001", "どうも", None, T0, 0),
        ("00003", "00002", "00001", "消", None, T0, 1),
        ("00004", "00001", "00001", "メモ", None, T0, 0),
    ],
}


def write(spark, folder: str) -> None:
    for name, schema in TABLES.items():
        spark.createDataFrame(ROWS[name], schema).coalesce(1).write.parquet(f"{folder}/{name}")
