import random

import pytest
from pyspark.sql import functions as F

from cradlemart.functions import text as tx
from cradlemart.operators import quality
from cradlemart.schemas import FEEDS

GOOD = dict(
    seq=1, email="a@x", password="abcdefg1", password_confirm="abcdefg1", name="山田", name_first="はな", name_kana="ヤマダ",
    name_kana_first="ハナ", username="u", birthday="2024/1/5", gender="女性", phone="090", children_count="1",
    postal_code="1234567", address="東京都", city="c", street="s", building="",
)
COLUMNS = [part.split()[0] for part in FEEDS["registration"].split(", ")]


def check(spark, forms, accounts=()):
    df = spark.createDataFrame([tuple({**GOOD, **f}[c] for c in COLUMNS) for f in forms], FEEDS["registration"])
    held = spark.createDataFrame(list(accounts), "account_name string, email string")
    out = quality.validate_registrations(df, held)
    assert "password" not in out.columns and "password_confirm" not in out.columns
    return {r.seq: r.errors for r in out.collect()}


def test_registration_rules(spark):
    cases = [
        ({}, {}),
        ({"password": "abcdefgh"}, {"password": "weak"}),
        ({"password": "ab1"}, {"password": "weak"}),
        ({"password": "abcdefg１", "password_confirm": "abcdefg１"}, {}),
        ({"password": None}, {"password": "weak"}),
        ({"password_confirm": "other"}, {"password_confirm": "mismatch"}),
        ({"password": "short", "password_confirm": "other"}, {"password": "weak"}),
        ({"name": "Yamada"}, {"name": "script"}),
        ({"name": "\U00020BB7田"}, {"name": "script"}),
        ({"name_first": "花子\n"}, {}),
        ({"name_kana": "はなこ"}, {"name_kana": "script"}),
        ({"birthday": "2024/02/30"}, {"birthday": "format"}),
        ({"birthday": "24/01/05"}, {"birthday": "format"}),
        ({"birthday": "2024/12/ 5"}, {}),
        ({"birthday": "２０２４/1/5"}, {}),
        ({"birthday": "2024-01-05"}, {"birthday": "format"}),
        ({"birthday": "0000/01/05"}, {"birthday": "format"}),
        ({"gender": "x"}, {"gender": "domain"}),
        ({"children_count": "3"}, {"children_count": "domain"}),
        ({"address": ""}, {}),
        ({"address": "atlantis"}, {"address": "domain"}),
        ({"username": ""}, {"username": "required"}),
        ({"phone": None}, {"phone": "required"}),
        ({"username": "held"}, {"username": "taken"}),
        ({"email": "held@x", "gender": "x"}, {"email": "taken", "gender": "domain"}),
    ]
    forms = [{"username": f"u{i}", "email": f"e{i}", **f, "seq": i} for i, (f, _) in enumerate(cases)]
    got = check(spark, forms, [("held", "held@x"), (None, None)])
    assert got == {i: want for i, (_, want) in enumerate(cases)}


@pytest.mark.parametrize("seed", [1, 2])
def test_names_first_come_first_served(spark, seed):
    rnd = random.Random(seed)
    forms = [
        {
            "seq": i, "username": f"u{rnd.randrange(25)}", "email": f"e{rnd.randrange(25)}",
            "gender": rnd.choice(["女性", "女性", "?"]),
        }
        for i in range(120)
    ]
    names, mails, want = {"u0"}, {"e0"}, {}
    for f in forms:
        errors = {"gender": "domain"} if f["gender"] == "?" else {}
        if f["username"] in names:
            errors["username"] = "taken"
        if f["email"] in mails:
            errors["email"] = "taken"
        if not errors:
            names.add(f["username"])
            mails.add(f["email"])
        want[f["seq"]] = errors
    rnd.shuffle(forms)
    assert check(spark, forms, [("u0", "e0")]) == want


def test_long_chain_of_clashes(spark):
    """Each form clashes with the next one only, so every second form is accepted."""
    forms = [{"seq": i, "username": f"u{i // 2}", "email": f"e{(i + 1) // 2}"} for i in range(14)]
    got = check(spark, forms)
    assert [i for i in sorted(got) if not got[i]] == list(range(0, 14, 2))


def listing(seq, **change):
    good = dict(
        channel="sale", account_id="1", productName="n", productCondition="未使用に近い", productDescription="", sellingPrice="¥ 300",
        categoryId="00001", shippingPayer="着払い(購入者負担)", shippingEstimate="3～4日で発送", rentalPeriod=None,
        uploads=["a.jpg", "", "", ""],
    )
    return (seq, *{**good, **change}.values())


def test_listing_rules(spark):
    cases = [
        ({}, {}),
        ({"sellingPrice": "299"}, {"price": "range"}),
        ({"sellingPrice": "299.999"}, {"price": "range"}),
        ({"sellingPrice": "9999999"}, {}),
        ({"sellingPrice": "10000000"}, {"price": "range"}),
        ({"sellingPrice": ""}, {"price": "number"}),
        ({"sellingPrice": "abc"}, {"price": "number"}),
        ({"sellingPrice": "１２００"}, {}),
        ({"productName": "長" * 41}, {"name": "too_long"}),
        ({"productName": None}, {"name": "required"}),
        ({"categoryId": "00005"}, {"category": "domain"}),
        ({"uploads": ["", "b.png", "", ""]}, {"upload": "required"}),
        ({"uploads": ["a.jpg", "b.gif", "", ""]}, {"upload": "type"}),
        ({"uploads": ["a.jpg", "b", "", ""]}, {"upload": "type"}),
        ({"uploads": ["a.JPEG", "", "", "d.gif"]}, {}),
        ({"channel": "rental"}, {"rental_period": "domain"}),
        ({"channel": "rental", "rentalPeriod": "1～2週"}, {}),
    ]
    df = spark.createDataFrame([listing(i, **c) for i, (c, _) in enumerate(cases)], FEEDS["listing_form"])
    assert {r.seq: r.errors for r in quality.validate_listings(df).collect()} == {i: w for i, (_, w) in enumerate(cases)}


def test_post_and_icon_rules(spark):
    df = spark.createDataFrame(
        [(1, "a", "t", [""], ["x.png", "", "", "y.gif"]), (2, "a", "", [""], None), (3, "a", "t" * 40, [""], ["x.jpg"])],
        FEEDS["post_form"],
    )
    got = {r.seq: r.errors for r in quality.validate(df, quality.post_rules()).collect()}
    assert got == {1: {"upload": "type"}, 2: {"title": "required"}, 3: {}}
    icons = spark.createDataFrame([(1, "i.PNG"), (2, ""), (3, "noext")], "seq long, file string")
    got = {r.seq: r.errors for r in quality.validate(icons, quality.icon_rules()).collect()}
    assert got == {1: {}, 2: {"upload": "missing"}, 3: {"upload": "type"}}


def test_profile_changes(spark):
    accounts = spark.createDataFrame([("1", "a"), ("2", "b")], "account_id string, account_name string")
    changes = spark.createDataFrame(
        [(1, "1", "b"), (2, "2", "b"), (3, "1", "c"), (4, "2", "c"), (5, "1", "c")], "seq long, account_id string, account_name string"
    )
    got = {r.seq: r.errors for r in quality.validate_profile_changes(changes, accounts).collect()}
    assert got == {1: {"username": "taken"}, 2: {}, 3: {}, 4: {"username": "taken"}, 5: {}}


def test_postal(spark):
    replies = spark.createDataFrame(
        [('{"results":[{"zipcode":"1234567","address1":"A","address2":"B","address3":"C"}]}',), ('{"results":null}',)], "body string"
    )
    rows = spark.createDataFrame([("123-4567",), ("1234567",), ("000",), ("",), (None,)], "postal_code string")
    got = quality.postal_enrich(rows, quality.postal_dimension(replies)).collect()
    assert sorted((r.postal_code or "", r.postal_town, r.postal_status) for r in got) == [
        ("", None, "missing"), ("", None, "missing"), ("000", None, "not_found"), ("123-4567", "C", "ok"), ("1234567", "C", "ok"),
    ]


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_texts(spark):
    lit = F.lit
    assert str(one(spark, tx.parse_price(lit("¥ 1,234")))) == "1234.00"
    assert one(spark, tx.whole_yen(lit("300.9").cast("decimal(12,2)"))) == 300
    assert [one(spark, tx.padded_id(lit(n))) for n in (1, 100000)] == ["00001", "100000"]
    assert one(spark, tx.same_id(lit("00001"), 1)) is True and one(spark, tx.same_id(lit("x"), 1)) is None
    assert [one(spark, tx.file_extension(lit(f))) for f in ("a.b.PNG", "plain")] == ["png", "plain"]
    assert [one(spark, tx.split_list(lit(t))) for t in ("a,b", "", None)] == [["a", "b"], [], []]
    assert one(spark, tx.count_filled(F.array(lit("a"), lit(" "), lit("")))) == 1
    assert one(spark, tx.public_path(lit("./static/images/x.png"))) == "images/x.png"
    assert [one(spark, tx.postal_mask(lit(t))) for t in ("12", "1234", "123-45678")] == ["12", "123-4", "123-4567"]
    assert [one(spark, tx.date_mask(lit(t))) for t in ("2024", "20241", "2024123", "2024/12/311")] == [
        "2024", "2024/1", "2024/12/3", "2024/12/31",
    ]
    assert [one(spark, tx.price_mask(lit(t))) for t in ("12x34", "123456789", "")] == ["¥ 1,234", "¥ 1,234,567", ""]
    assert one(spark, tx.digits_only(lit("090-1２3"))) == "09013"
    assert one(spark, tx.japanese_time(lit("2024-01-02 03:04:05").cast("timestamp"))) == "2024年01月02日 03:04:05"


def test_profile_change_comes_out_once_when_two_accounts_share_the_name(spark):
    accounts = spark.createDataFrame([(1, "n"), (2, "n"), (3, "m")], "account_id long, account_name string")
    changes = spark.createDataFrame([(1, 3, "n"), (2, 3, "m"), (3, 1, "n")], "seq long, account_id long, account_name string")
    got = {r.seq: dict(r.errors) for r in quality.validate_profile_changes(changes, accounts).collect()}
    assert got == {1: {"username": "taken"}, 2: {}, 3: {"username": "taken"}}


def test_first_result_of_a_postal_reply(spark):
    body = '{"results": [{"zipcode": "1", "address1": "Z", "address2": "first", "address3": "x"}, {"zipcode": "1", "address1": "A"}]}'
    replies = spark.createDataFrame([(body,), ('{"results": null}',)], "body string")
    assert [tuple(r) for r in quality.postal_dimension(replies).collect()] == [("1", "Z", "first", "x")]


def test_first_place_of_a_postal_code(spark):
    columns = "zipcode string, prefecture string, city string, town string"
    rows = spark.createDataFrame([("1",)], "postal_code string")
    postal = spark.createDataFrame([("1", "Z", "first", "x"), ("1", "A", "second", "y")], columns).coalesce(1)
    assert quality.postal_enrich(rows, postal).first().postal_city == "first"
    told = spark.createDataFrame([("1", "A", "second", "y", 2), ("1", "Z", "first", "x", 1)], columns + ", position int")
    assert quality.postal_enrich(rows, told).first().postal_city == "first"
