"""The same answers in plain SQL for DuckDB, on the same test tables.

``VIEWS`` repeats the test-table views of ``sources/driver.py`` in SQL; each oracle names the views
it needs. Where the library uses a closed form or several rounds, the SQL takes another road (for
the points ledger a recursive row-by-row replay).
"""

from __future__ import annotations

import re

from ..schemas import (
    CATEGORIES, CONDITION_TAGS, CONDITIONS, GENDERS, LISTED, PAY_CARD, PAY_POINTS, PREFECTURES, PRICE_ABOVE,
    PRICE_BANDS, RENTAL_PERIODS, SHIPPING_ESTIMATES, SHIPPING_PAYERS, SOLD, TAG_ONLY_IN,
)


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pick(values: list[str], key: str) -> str:
    return f"{_list(values)}[({key}) % {len(values)} + 1]"


def _channel(key: str) -> str:
    return f"CASE WHEN ({key}) % 3 = 0 THEN 'rental' ELSE 'sale' END"


def _errors(*rules: tuple[str, str]) -> str:
    """Sorted ``field:code`` text; each rule is (field, SQL that gives a code or NULL)."""
    items = ", ".join(f"'{field}:' || ({code})" for field, code in rules)
    return f"coalesce(array_to_string(list_sort(list_filter([{items}], lambda x: x IS NOT NULL)), ','), '')"


_SHOWN = "'%Y-%m-%d %H:%M:%S'"
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

VIEWS = {
    "account": """
        SELECT c_custkey AS account_id, c_name AS account_name,
               './static/images/' || c_mktsegment || '.jpg' AS icon, lower(c_name) || '@example.com' AS email,
               printf('%010d', c_custkey * 7919) AS phone, CAST(c_custkey % 3 AS INT) AS children,
               CAST(floor(c_acctbal) AS BIGINT) AS points
        FROM customer""",
    "address": f"""
        SELECT printf('%05d', c_custkey + 1) AS address_id, c_custkey AS account_id,
               CASE WHEN c_custkey % 9 = 4 THEN '' WHEN c_custkey % 9 = 5 THEN '9999999'
                    ELSE substr(printf('%07d', CAST(c_nationkey AS BIGINT) * 10007), 1, 3) || '-' ||
                         substr(printf('%07d', CAST(c_nationkey AS BIGINT) * 10007), 4, 4) END AS postal_code,
               {_pick(PREFECTURES, 'c_custkey')} AS prefecture, c_mktsegment AS city_ward,
               CAST(c_nationkey AS VARCHAR) AS address_number,
               CASE WHEN c_custkey % 4 = 0 THEN c_name END AS building
        FROM customer""",
    "category": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in CATEGORIES.items())
    + ") AS t(category_id, category_name)",
    "listing": f"""
        SELECT {_channel('o_orderkey')} AS channel, o_orderkey AS listing_id, o_custkey AS seller_id,
               '0000' || substr(o_orderpriority, 1, 1) AS category_id, p_name AS name,
               {_pick(CONDITIONS, 'o_orderkey')} AS condition, p_type AS description,
               CAST(floor(o_totalprice / 50) AS DECIMAL(12,2)) AS price,
               {_pick(SHIPPING_PAYERS, 'o_orderkey')} AS shipping_payer,
               {_pick(SHIPPING_ESTIMATES, 'o_orderkey')} AS shipping_estimate,
               CASE WHEN o_orderkey % 3 = 0 THEN {_pick(RENTAL_PERIODS, 'o_orderkey')} END AS rental_period,
               o_orderdate AS listed_at, CASE WHEN o_orderstatus = 'F' THEN '{SOLD}' ELSE '{LISTED}' END AS status,
               CAST(o_orderkey % 17 = 0 AS INT) AS deleted
        FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)""",
    "category_status": f"""
        SELECT {_channel('o_orderkey')} AS channel, printf('%05d', o_orderkey + 1) AS status_id,
               o_orderkey AS listing_id,
               CASE WHEN o_orderkey % 10 = 3 THEN '00001' ELSE '0000' || substr(o_orderpriority, 1, 1) END AS category_id
        FROM orders""",
    "photo": f"""
        SELECT {_channel('l_orderkey')} AS channel, l_partkey * 100 + l_linenumber AS photo_id,
               l_orderkey AS listing_id,
               CASE WHEN l_partkey % 31 = 0 THEN ' '
                    ELSE './static/upload/' || l_partkey || '_' || l_linenumber || '.jpg' END AS path
        FROM lineitem""",
    "cover": "SELECT channel, listing_id, max(path) AS cover FROM photo GROUP BY ALL",
    "grid": """
        SELECT channel, listing_id, cover, CAST(trunc(price) AS BIGINT) AS price, name, status, deleted
        FROM listing LEFT JOIN cover USING (channel, listing_id)""",
    "numbered_photo": """
        SELECT *, row_number() OVER (PARTITION BY channel, listing_id ORDER BY photo_id, path) AS n FROM photo""",
    "comment_form": f"""
        SELECT event_id AS seq, {_channel('event_id // 3 * 31 % (SELECT count(*) FROM orders)')} AS channel, event_id // 3 * 31 % (SELECT count(*) FROM orders) AS listing_id,
               user_id AS author_id, 'comment ' || props AS content
        FROM events WHERE event_type = 'view'""",
    "comment": """
        SELECT channel, seq AS comment_id, listing_id, author_id, content, CAST(seq % 10 = 3 AS INT) AS deleted
        FROM comment_form""",
    "follow_log": f"""
        SELECT event_id AS seq, {_K} AS followed_id, user_id AS follower_id,
               CASE WHEN event_type = 'click' THEN 'follow' ELSE 'unfollow' END AS action
        FROM events WHERE event_type IN ('click', 'error')""",
    "follow": """
        SELECT followed_id, follower_id, printf('%05d', follower_id * 100 + followed_id) AS follow_id
        FROM (SELECT *, row_number() OVER (PARTITION BY followed_id, follower_id ORDER BY seq DESC) AS r FROM follow_log)
        WHERE r = 1 AND action = 'follow'""",
    "ledger_event": """
        SELECT user_id AS account_id, event_id AS seq,
               CASE event_type WHEN 'signup' THEN 'reset' WHEN 'click' THEN 'grant' WHEN 'view' THEN 'credit'
                    ELSE 'debit' END AS kind,
               CAST(CASE event_type WHEN 'signup' THEN 0 WHEN 'click' THEN floor(value * 1000000)
                    ELSE floor(value) END AS BIGINT) AS amount
        FROM events WHERE event_type <> 'error'""",
    "purchase": f"""
        SELECT seq, {_channel('listing_id')} AS channel, listing_id, account_id, method,
               CASE WHEN seq % 70 = 11 THEN 99999999999 ELSE (seq * 37) % 9700 + 300 END AS price,
               CASE WHEN seq % 50 = 12 THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END AS claimed
        FROM (SELECT event_id AS seq, value, user_id AS account_id,
                     CASE WHEN event_id % 40 = 7 THEN -event_id ELSE event_id // 3 * 31 % (SELECT count(*) FROM orders) END AS listing_id,
                     CASE WHEN event_id % 2 = 0 THEN '{PAY_POINTS}' ELSE '{PAY_CARD}' END AS method
              FROM events WHERE event_type = 'purchase')""",
    "checked": f"""
        SELECT p.*, l.seller_id, l.status, l.deleted,
               CASE WHEN l.listing_id IS NULL THEN 'missing_listing'
                    WHEN p.price > 9999999999 OR method = '{PAY_POINTS}' AND claimed IS NULL THEN 'bad_number'
                    WHEN method = '{PAY_POINTS}' AND claimed < p.price THEN 'not_enough_points' END AS reason
        FROM purchase p LEFT JOIN listing l ON p.channel = l.channel AND p.listing_id = l.listing_id""",
    "moves": f"""
        SELECT seller_id AS account_id, seq, 'credit' AS kind, price AS amount FROM checked WHERE reason IS NULL
        UNION ALL
        SELECT account_id, seq, 'debit', price FROM checked WHERE reason IS NULL AND method = '{PAY_POINTS}'""",
    "last_sale": f"""
        SELECT {_channel('o_orderkey')} AS channel, max(o_orderkey + 1) AS last FROM orders
        WHERE o_orderstatus = 'F' GROUP BY ALL""",
    "sold": """
        SELECT c.channel, printf('%05d', coalesce(last, 0) + row_number() OVER (PARTITION BY c.channel ORDER BY seq)) AS transaction_id,
               listing_id, account_id AS buyer_id, method AS payment_method, 0 AS status
        FROM checked c LEFT JOIN last_sale s ON s.channel = c.channel WHERE reason IS NULL""",
    "dm": f"""
        SELECT event_id AS dm_id, {_K} AS receiver_id, user_id AS sender_id, event_type || ' ' || event_id AS content,
               CAST(NULL AS VARCHAR) AS media, ts AS sent_at, CAST(event_id % 10 = 0 AS INT) AS deleted
        FROM events""",
    "thread": """
        SELECT least(sender_id, receiver_id) AS low_id, greatest(sender_id, receiver_id) AS high_id,
               row_number() OVER (PARTITION BY least(sender_id, receiver_id), greatest(sender_id, receiver_id)
                                  ORDER BY sent_at, dm_id) AS position,
               dm_id, sender_id, receiver_id, account_name AS receiver_name, content, media,
               strftime(sent_at, '%Y年%m月%d日 %H:%M:%S') AS sent_at_text
        FROM dm LEFT JOIN account ON account_id = receiver_id WHERE deleted = 0""",
    "post": f"""
        SELECT DISTINCT conv_id AS post_id, conv_id % (SELECT count(*) FROM customer) AS account_id, 'post ' || conv_id AS title,
               strftime(TIMESTAMP '2024-01-01' + to_minutes(conv_id), {_SHOWN}) AS posted_at,
               CAST(conv_id % 5 = 0 AS INT) AS visibility, CAST(conv_id % 7 = 0 AS INT) AS deleted
        FROM conversations""",
    "post_content": "SELECT conv_id * 1000 + turn AS content_id, conv_id AS post_id, text FROM conversations",
    "post_media": """
        SELECT conv_id * 1000 + turn AS media_id, conv_id * 1000 + turn AS content_id, conv_id AS post_id,
               './static/upload/' || (conv_id * 1000 + turn) || '.jpg' AS path
        FROM conversations WHERE role = 'assistant'""",
    "slot": """
        SELECT f.seq, f.conv_id, f.no, s.slot, coalesce(t.text, '') AS text, t.turn, t.role
        FROM (SELECT *, row_number() OVER (ORDER BY seq) AS no
              FROM (SELECT DISTINCT conv_id * 1000 + turn // 4 AS seq, conv_id FROM conversations)
              WHERE conv_id % 11 <> 3 AND conv_id % 13 <> 4) f
        CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS slot) s
        LEFT JOIN conversations t ON t.conv_id = f.conv_id AND f.seq = t.conv_id * 1000 + t.turn // 4 AND t.turn % 4 = s.slot""",
    "registration": f"""
        SELECT c_custkey AS seq,
               CASE WHEN c_custkey % 10 = 8 THEN lower(c_name) || '@example.com'
                    ELSE 'mail' || CASE WHEN c_custkey % 10 = 6 THEN c_custkey - 1 ELSE c_custkey END || '@example.com'
               END AS email,
               CASE WHEN c_custkey % 10 = 3 THEN c_name
                    ELSE 'user' || CASE WHEN c_custkey % 10 = 1 THEN c_custkey - 1 ELSE c_custkey END END AS username,
               CASE WHEN c_custkey % 19 = 7 THEN '2024/02/30' WHEN c_custkey % 19 = 8 THEN '24/01/05'
                    ELSE (c_custkey % 50 + 1970) || '/' || (c_custkey % 12 + 1) || '/' || (c_custkey % 28 + 1)
               END AS birthday,
               {_errors(
                   ('password', "CASE WHEN c_custkey % 7 IN (2, 3) THEN 'weak' END"),
                   ('password_confirm', "CASE WHEN c_custkey % 7 NOT IN (2, 3) AND c_custkey % 11 = 4 THEN 'mismatch' END"),
                   ('name', "CASE WHEN c_custkey % 13 = 5 THEN 'script' END"),
                   ('name_kana', "CASE WHEN c_custkey % 17 = 6 THEN 'script' END"),
                   ('birthday', "CASE WHEN c_custkey % 19 IN (7, 8) THEN 'format' END"),
                   ('gender', "CASE WHEN c_custkey % 23 = 9 THEN 'domain' END"),
                   ('children_count', "CASE WHEN c_custkey % 29 = 10 THEN 'domain' END"),
                   ('address', "CASE WHEN c_custkey % 31 = 11 THEN 'domain' END"))} AS own_errors,
               c_name AS c_name, c_mktsegment, c_nationkey
        FROM customer""",
    # Names clash in pairs only here, so a name is taken by the table or by one earlier valid form.
    "registration_checked": """
        SELECT r.*, (hu.account_id IS NOT NULL OR pu.seq IS NOT NULL) AS username_taken,
               (he.account_id IS NOT NULL OR pe.seq IS NOT NULL) AS email_taken
        FROM registration r
        LEFT JOIN account hu ON hu.account_name = r.username
        LEFT JOIN account he ON he.email = r.email
        LEFT JOIN registration pu ON pu.username = r.username AND pu.seq < r.seq AND pu.own_errors = ''
             AND NOT EXISTS (SELECT 1 FROM account a WHERE a.account_name = pu.username OR a.email = pu.email)
        LEFT JOIN registration pe ON pe.email = r.email AND pe.seq < r.seq AND pe.own_errors = ''
             AND NOT EXISTS (SELECT 1 FROM account a WHERE a.account_name = pe.username OR a.email = pe.email)""",
    "registration_errors": """
        SELECT seq, array_to_string(list_sort(list_filter(
                   string_split(own_errors, ',') || [CASE WHEN username_taken THEN 'username:taken' END,
                                                     CASE WHEN email_taken THEN 'email:taken' END],
                   lambda x: x IS NOT NULL AND x <> '')), ',') AS errors
        FROM registration_checked""",
    "accepted": f"""
        SELECT r.*, row_number() OVER (ORDER BY seq) AS no, {_pick(GENDERS, 'seq')} AS gender,
               '090-' || printf('%04d', seq % 10000) AS phone, CAST(seq % 3 AS INT) AS children,
               printf('%07d', seq * 37 % 10000000) AS postal_code,
               CASE WHEN seq % 31 = 12 THEN '' ELSE {_pick(PREFECTURES, 'seq')} END AS prefecture
        FROM registration r SEMI JOIN (SELECT seq AS s FROM registration_errors WHERE errors = '') ON s = r.seq""",
    "listing_form": f"""
        SELECT o_orderkey AS seq, {_channel('o_orderkey')} AS channel, o_custkey AS account_id, o_orderpriority,
               CAST(floor(o_totalprice / 50) AS BIGINT) AS yen,
               CASE WHEN o_orderkey % 43 = 7 OR o_orderkey % 47 = 8 THEN NULL
                    ELSE CAST(floor(o_totalprice / 50) AS BIGINT) END AS price,
               CASE WHEN o_orderkey % 37 = 5 THEN '' WHEN o_orderkey % 41 = 6 THEN repeat('長', 41)
                    ELSE 'item ' || o_orderkey END AS name,
               CASE WHEN o_orderkey % 53 = 9 THEN '' ELSE 'a' || o_orderkey || '.jpg' END AS f1,
               CASE WHEN o_orderkey % 59 = 10 THEN 'b.gif' WHEN o_orderkey % 4 = 1 THEN 'b' || o_orderkey || '.PNG'
                    ELSE '' END AS f2,
               CASE WHEN o_orderkey % 5 = 0 THEN 'd.gif' ELSE '' END AS f4
        FROM orders""",
    "listing_errors": """
        SELECT *, """ + _errors(
        ("upload", "CASE WHEN f1 = '' THEN 'required' WHEN f2 = 'b.gif' THEN 'type' END"),
        ("price", "CASE WHEN price IS NULL THEN 'number' WHEN price < 300 OR price > 9999999 THEN 'range' END"),
        ("name", "CASE WHEN name = '' THEN 'required' WHEN length(name) > 40 THEN 'too_long' END"),
        ("category", "CASE WHEN substr(o_orderpriority, 1, 1) NOT IN ('1', '2', '3', '4') THEN 'domain' END"),
        ("condition", "CASE WHEN seq % 61 = 1 THEN 'domain' END"),
        ("shipping_estimate", "CASE WHEN seq % 67 = 2 THEN 'domain' END"),
        ("rental_period", "CASE WHEN channel = 'rental' AND seq % 9 = 3 THEN 'domain' END"),
    ) + """ AS errors
        FROM listing_form""",
    "listed": """
        SELECT *, row_number() OVER (PARTITION BY channel ORDER BY seq) AS no,
               (SELECT max(listing_id) FROM listing l WHERE l.channel = e.channel) AS last_listing,
               (SELECT max(CAST(status_id AS BIGINT)) FROM category_status s WHERE s.channel = e.channel) AS last_status
        FROM listing_errors e WHERE errors = ''""",
    "profile_change": f"""
        SELECT event_id AS seq, user_id AS account_id,
               'nick' || CASE WHEN event_id % 8 = 0 THEN 0 ELSE event_id END AS account_name,
               CASE WHEN event_id % 4 <> 0 THEN '080' || event_id END AS phone, CAST(event_id % 3 AS INT) AS children,
               printf('%07d', event_id) AS postal_code, {_pick(PREFECTURES, 'event_id')} AS prefecture,
               event_type AS city_ward, CAST(event_id AS VARCHAR) AS address_number
        FROM events WHERE event_type = 'click'""",
    # One change after the other. Keys: an account's name now; -1 the number of the change; below that the outcomes.
    "profile_replay": """
        WITH RECURSIVE c AS (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM profile_change),
        held(k, name, n) USING KEY (k) AS (
            SELECT account_id, account_name, 0 FROM account
            UNION ALL SELECT -1, NULL, 0
            UNION
            SELECT CASE i WHEN 1 THEN -1 WHEN 2 THEN -1 - x.n ELSE x.account_id END,
                   CASE i WHEN 2 THEN x.errors WHEN 3 THEN x.account_name END, x.n
            FROM (SELECT c.*, CASE WHEN EXISTS (SELECT 1 FROM recurring.held h WHERE h.name = c.account_name
                                                AND h.k >= 0 AND h.k <> c.account_id) THEN 'username:taken' ELSE '' END AS errors
                  FROM held w JOIN c ON w.k = -1 AND c.n = w.n + 1) x, (VALUES (1), (2), (3)) v(i)
            WHERE i < 3 OR x.errors = '')
        SELECT n, name AS errors FROM held WHERE k < -1""",
    "profile_checked": """
        SELECT c.* EXCLUDE (n), r.errors
        FROM (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM profile_change) c JOIN profile_replay r USING (n)""",
    "profile_latest": """
        SELECT * FROM profile_checked WHERE errors = ''
        QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY seq DESC) = 1""",
    "edit": f"""
        SELECT * FROM (
            SELECT event_id AS seq, {_channel('event_id // 3 * 31 % (SELECT count(*) FROM orders)')} AS channel, event_id // 3 * 31 % (SELECT count(*) FROM orders) AS listing_id,
                   'edited ' || event_id AS name, {_pick(CONDITIONS, 'event_id')} AS condition,
                   CASE WHEN event_id % 3 <> 0 THEN props END AS description,
                   CAST(floor(value * 100) AS BIGINT) AS price, {_pick(SHIPPING_PAYERS, 'event_id')} AS shipping_payer,
                   {_pick(SHIPPING_ESTIMATES, 'event_id')} AS shipping_estimate,
                   printf('%05d', event_id % 4 + 1) AS category_id, {_pick(RENTAL_PERIODS, 'event_id')} AS rental_period
            FROM events WHERE event_type = 'error' AND event_id % 9 <> 4)
        QUALIFY row_number() OVER (PARTITION BY channel, listing_id ORDER BY seq DESC) = 1""",
    "photo_upload": f"""
        SELECT {_channel('event_id // 3 * 31 % (SELECT count(*) FROM orders)')} AS channel, event_id // 3 * 31 % (SELECT count(*) FROM orders) AS listing_id,
               './static/upload/new_' || max(event_id) || '.jpg' AS path
        FROM events WHERE event_type = 'signup' GROUP BY ALL""",
    "icon_upload": """
        SELECT user_id AS account_id, max(event_id) AS event_id FROM events
        WHERE event_type = 'signup' AND event_id % 6 NOT IN (0, 1) GROUP BY ALL""",
    "postal": """
        SELECT printf('%07d', CAST(n_nationkey AS BIGINT) * 10007) AS zipcode, r_name AS prefecture, n_name AS city,
               n_name || '-' || n_nationkey AS town
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "replay": """
        SELECT account_id, seq, kind, amount, rn,
               CAST(CASE kind WHEN 'grant' THEN least(amount, 99999999) WHEN 'reset' THEN 0 WHEN 'credit' THEN amount
                    ELSE -amount END AS BIGINT) AS balance
        FROM ledger_row WHERE rn = 1
        UNION ALL
        SELECT e.account_id, e.seq, e.kind, e.amount, e.rn,
               CAST(CASE e.kind WHEN 'grant' THEN CASE WHEN r.balance + e.amount >= 100000000 THEN 99999999
                                                       ELSE r.balance + e.amount END
                    WHEN 'reset' THEN 0 WHEN 'credit' THEN r.balance + e.amount ELSE r.balance - e.amount END AS BIGINT)
        FROM replay r JOIN ledger_row e ON e.account_id = r.account_id AND e.rn = r.rn + 1""",
    "ledger_row": """
        SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY seq) AS rn FROM ledger_event""",
    "opened_row": """
        SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY seq NULLS FIRST) AS rn
        FROM (SELECT * FROM ledger_event UNION ALL SELECT account_id, NULL, 'credit', points FROM account)""",
    "last_balance": """
        SELECT account_id, balance AS points FROM replay
        QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY seq DESC) = 1""",
    "state": f"""
        SELECT channel, listing_id, CASE WHEN bool_or(kind = 'sold') THEN '{SOLD}' ELSE '{LISTED}' END AS status,
               CAST(bool_or(kind = 'deleted') AS INT) AS deleted
        FROM (SELECT {_channel('o_orderkey')} AS channel, o_orderkey AS listing_id,
                     CASE WHEN o_orderstatus = 'F' THEN 'sold' ELSE 'listed' END AS kind FROM orders
              UNION ALL
              SELECT {_channel('event_id // 3 * 31 % (SELECT count(*) FROM orders)')}, event_id // 3 * 31 % (SELECT count(*) FROM orders),
                     CASE WHEN event_type = 'purchase' THEN 'sold' ELSE 'deleted' END
              FROM events WHERE event_type IN ('purchase', 'error'))
        GROUP BY ALL""",
}
VIEWS["replay_opened"] = VIEWS["replay"].replace("ledger_row", "opened_row").replace("FROM replay r", "FROM replay_opened r")

_RECURSIVE = ("replay", "replay_opened")


def _needs(sql: str) -> list[str]:
    """Views a statement reads, each after the views it reads itself."""
    found: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
            inner = VIEWS[name]
            for other in [*(_needs(inner) if name not in _RECURSIVE else _needs(re.sub(rf"FROM {name} r", "", inner))), name]:
                if other not in found:
                    found.append(other)
    return found


def _sql(body: str) -> str:
    views = _needs(body)
    if not views:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{v} AS MATERIALIZED ({VIEWS[v]})" for v in views) + "\n" + body


def _tagged(*rules: tuple[str, str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT channel, listing_id, '{tag}' AS tag FROM listing WHERE {test}" for tag, test in rules
    )


_CATEGORY = [(name, f"category_id = '{key}'") for key, name in CATEGORIES.items()]
_CONDITION = [
    (tag, f"condition = '{stored}'" + (f" AND channel = '{TAG_ONLY_IN[tag]}'" if tag in TAG_ONLY_IN else ""))
    for tag, stored in CONDITION_TAGS.items()
]
_PRICE = [(tag, f"price BETWEEN {lo} AND {hi}") for tag, (lo, hi) in PRICE_BANDS.items()]
_PRICE.append((PRICE_ABOVE[0], f"price > {PRICE_ABOVE[1]}"))


def _keyword(tests: dict[str, str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{term}' AS term, channel, listing_id, name FROM listing WHERE {test}" for term, test in tests.items()
    )


_LISTING_TEXT = f"""channel, listing_id, seller_id, category_id, name, condition, description,
    CAST(trunc(price) AS BIGINT) AS price, shipping_payer, shipping_estimate, rental_period,
    strftime(listed_at, {_SHOWN}) AS listed_at, status, deleted"""


def _edited(channel: str, columns: list[str]) -> str:
    cols = ["category_id", "name", "condition", "description", "shipping_payer", "shipping_estimate", "rental_period"]
    shown = [
        f"CASE WHEN e.seq IS NULL THEN l.{x} ELSE e.{x} END AS {x}" if x in columns else f"l.{x}" for x in cols
    ]
    return f"""
        SELECT l.channel, l.listing_id, l.seller_id, {", ".join(shown)},
               CASE WHEN e.seq IS NULL THEN CAST(trunc(l.price) AS BIGINT) ELSE e.price END AS price,
               strftime(l.listed_at, {_SHOWN}) AS listed_at, l.status, l.deleted
        FROM listing l LEFT JOIN edit e
             ON e.channel = l.channel AND e.listing_id = l.listing_id AND e.channel = '{channel}'"""


def _edited_category(channel: str) -> str:
    return f"""
        SELECT s.channel, s.status_id, s.listing_id, coalesce(e.category_id, s.category_id) AS category_id
        FROM category_status s LEFT JOIN edit e
             ON e.channel = s.channel AND e.listing_id = s.listing_id AND e.channel = '{channel}'"""


_EDIT = ["name", "condition", "description", "shipping_payer", "shipping_estimate"]

_BODIES = {
    "browse": "SELECT * FROM grid",
    "visible": f"SELECT *, status = '{SOLD}' AS sold_out FROM grid WHERE cover <> '' AND deleted = 0",
    "catalog_union": f"SELECT {_LISTING_TEXT} FROM listing",
    "keyword_search": _keyword({t: f"contains(name, '{t}')" for t in ("ring", "blue", "e w", "Z", "")}),
    "keyword_wildcards": _keyword({t: f"name LIKE '%{t}%'" for t in ("r_d", "b%t", "100%", "e\\w")}),
    "keyword_terms": """
        SELECT term, count(*) AS n
        FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part) t
        JOIN listing ON contains(name, term) GROUP BY term""",
    "facet_category": _tagged(*_CATEGORY),
    "facet_condition": _tagged(*_CONDITION),
    "facet_price": _tagged(*_PRICE),
    "facet_index": _tagged(*_CATEGORY, *_CONDITION, *_PRICE),
    "facet_counts": f"SELECT channel, tag, count(*) AS n FROM ({_tagged(*_CATEGORY, *_CONDITION, *_PRICE)}) GROUP BY ALL",
    "item_detail": """
        SELECT l.channel, l.listing_id, seller_id, name, condition, description, CAST(trunc(price) AS BIGINT) AS price,
               shipping_payer, shipping_estimate, rental_period, status, deleted, c.category_id, category_name,
               CAST(1 AS BIGINT) AS first_no, coalesce(photos, '') AS photos
        FROM listing l
        LEFT JOIN category c ON c.category_id = l.category_id
        LEFT JOIN (SELECT channel, listing_id, string_agg(path, ',' ORDER BY n) AS photos
                   FROM numbered_photo GROUP BY ALL) p ON p.channel = l.channel AND p.listing_id = l.listing_id""",
    "photo_slots": """
        SELECT l.channel, l.listing_id, """ + ", ".join(
        f"CASE WHEN p.listing_id IS NULL THEN '' ELSE p.photo{i} END AS photo{i}" for i in range(1, 5)
    ) + """, coalesce(photo_count, 0) AS photo_count
        FROM listing l
        LEFT JOIN (SELECT channel, listing_id, """ + ", ".join(
        f"max(path) FILTER (n = {i}) AS photo{i}" for i in range(1, 5)
    ) + """, count(*) FILTER (trim(path) <> '') AS photo_count
                   FROM numbered_photo GROUP BY ALL) p ON p.channel = l.channel AND p.listing_id = l.listing_id""",
    "comments": """
        SELECT channel, listing_id, comment_id, author_id, content, deleted, account_name AS author_name, icon
        FROM comment LEFT JOIN account ON account_id = author_id""",
    "comments_live": """
        SELECT channel, listing_id, comment_id, author_id, content, deleted, account_name AS author_name, icon
        FROM comment LEFT JOIN account ON account_id = author_id WHERE deleted = 0""",
    "comment_counts": "SELECT channel, listing_id, count(*) AS comment_count FROM comment GROUP BY ALL",
    "seller": """
        SELECT channel, listing_id, seller_id, account_name AS seller_name, icon
        FROM listing JOIN account ON account_id = seller_id""",
    "storefront": """
        SELECT g.*, l.seller_id FROM grid g JOIN listing l ON l.channel = g.channel AND l.listing_id = g.listing_id
        WHERE g.channel = 'sale'""",
    "viewer_action": f"""
        SELECT viewer_id, l.channel, l.listing_id,
               CASE WHEN viewer_id = seller_id AND status = '{SOLD}' AND l.channel = 'sale' THEN 'owner_sold'
                    WHEN viewer_id = seller_id THEN 'owner' WHEN status = '{SOLD}' THEN 'sold' ELSE 'buy' END AS action
        FROM (SELECT user_id AS viewer_id, event_id // 3 * 31 % (SELECT count(*) FROM orders) AS lid FROM events WHERE event_type = 'view'
              UNION ALL SELECT o_custkey, o_orderkey FROM orders) JOIN listing l ON l.listing_id = lid""",
    "account_profile": """
        SELECT a.*, d.address_id, d.postal_code, d.prefecture, d.city_ward, d.address_number, d.building
        FROM account a LEFT JOIN address d ON d.account_id = a.account_id""",
    "follow_now": "SELECT followed_id, follower_id FROM follow",
    "follow_add": f"""
        SELECT followed_id, follower_id, seq,
               printf('%05d', (SELECT max(CAST(follow_id AS BIGINT)) FROM follow) + row_number() OVER (ORDER BY seq)) AS follow_id
        FROM (SELECT {_K} AS followed_id, user_id AS follower_id, min(event_id) AS seq FROM events GROUP BY ALL) w
        ANTI JOIN follow USING (followed_id, follower_id)""",
    "follow_remove": """
        SELECT DISTINCT followed_id, follower_id FROM follow_log l
        WHERE NOT EXISTS (SELECT 1 FROM follow_log u WHERE u.action = 'unfollow' AND u.followed_id = l.followed_id
                          AND u.follower_id = l.follower_id)""",
    "follow_counts": """
        SELECT account_id, CAST(sum(a) AS BIGINT) AS n_following, CAST(sum(b) AS BIGINT) AS n_followers
        FROM (SELECT follower_id AS account_id, 1 AS a, 0 AS b FROM follow
              UNION ALL SELECT followed_id, 0, 1 FROM follow) GROUP BY ALL""",
    "following": """
        SELECT follower_id, followed_id, account_name AS followed_name FROM follow JOIN account ON account_id = followed_id""",
    "followers": """
        SELECT follower_id, followed_id, a.account_name AS followed_name, b.account_name AS follower_name
        FROM follow JOIN account a ON a.account_id = followed_id JOIN account b ON b.account_id = follower_id""",
    "follow_flag": f"""
        SELECT viewer_id, account_id, f.followed_id IS NOT NULL AS followed
        FROM (SELECT DISTINCT user_id AS viewer_id, {_K} AS account_id FROM events) c
        LEFT JOIN follow f ON f.follower_id = viewer_id AND f.followed_id = account_id
        WHERE viewer_id <> account_id""",
    "dm_threads": "SELECT * FROM thread",
    "dm_sides": """
        SELECT low_id AS viewer_id, high_id AS partner_id, position,
               CASE WHEN sender_id = low_id THEN 'self' ELSE 'other' END AS side, dm_id, content, sent_at_text FROM thread
        UNION ALL
        SELECT high_id, low_id, position, CASE WHEN sender_id = high_id THEN 'self' ELSE 'other' END,
               dm_id, content, sent_at_text FROM thread WHERE low_id <> high_id""",
    "post_feed": """
        SELECT post_id, p.account_id, account_name, title FROM post p LEFT JOIN account a ON a.account_id = p.account_id""",
    "post_feed_live": """
        SELECT post_id, p.account_id, account_name, title FROM post p LEFT JOIN account a ON a.account_id = p.account_id
        WHERE deleted = 0 AND visibility = 0""",
    "post_detail": """
        SELECT p.post_id, p.account_id, account_name, title, posted_at, visibility, deleted, CAST(1 AS BIGINT) AS first_no,
               content_ids, texts, media_ids, media
        FROM post p LEFT JOIN account a ON a.account_id = p.account_id
        LEFT JOIN (SELECT post_id, string_agg(content_id, ',' ORDER BY content_id) AS content_ids
                   FROM post_content GROUP BY ALL) c ON c.post_id = p.post_id
        LEFT JOIN (SELECT post_id, string_agg(text, ',' ORDER BY content_id) AS texts
                   FROM (SELECT post_id, text, min(content_id) AS content_id FROM post_content GROUP BY ALL)
                   GROUP BY ALL) t ON t.post_id = p.post_id
        LEFT JOIN (SELECT post_id, string_agg(media_id, ',' ORDER BY media_id) AS media_ids,
                          string_agg(path, ',' ORDER BY media_id) AS media
                   FROM post_media GROUP BY ALL) m ON m.post_id = p.post_id""",
    "post_html": "SELECT content_id, post_id, replace(text, chr(10), '<br>') AS html FROM post_content",
    "post_publish": """
        SELECT printf('%05d', (SELECT max(content_id) FROM post_content) + (no - 1) * 4 + slot + 1) AS content_id,
               printf('%05d', (SELECT max(post_id) FROM post) + no) AS post_id, text
        FROM slot""",
    "post_publish_posts": """
        SELECT printf('%05d', (SELECT max(post_id) FROM post) + no) AS post_id, conv_id % (SELECT count(*) FROM customer) AS account_id,
               'post ' || conv_id AS title, '2024-01-01 00:00:00' AS posted_at, 0 AS visibility, 0 AS deleted
        FROM slot WHERE slot = 0""",
    "post_publish_media": """
        SELECT printf('%05d', (SELECT max(media_id) FROM post_media) + row_number() OVER (ORDER BY seq, slot)) AS media_id,
               printf('%05d', (SELECT max(content_id) FROM post_content) + (no - 1) * 4 + slot + 1) AS content_id,
               './static/upload/' || (conv_id % (SELECT count(*) FROM customer)) || '_' || seq || '_' || (slot + 1) || '_img' || turn || '.png' AS path
        FROM slot WHERE role = 'assistant'""",
    "points_ledger": "SELECT account_id, seq, kind, amount, balance FROM replay",
    "points_ledger_opening": "SELECT account_id, seq, kind, amount, balance FROM replay_opened",
    "points_balance": """
        SELECT a.account_id, coalesce(b.points, 0) AS points FROM account a
        LEFT JOIN last_balance b ON b.account_id = a.account_id""",
    "points_commands": """
        SELECT user_id AS account_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'reset' ELSE 'grant' END AS kind,
               CAST(CASE WHEN event_type = 'signup' THEN 0 WHEN event_id % 5 = 2 THEN NULL
                    ELSE floor(value * 1000000) END AS BIGINT) AS amount
        FROM events WHERE event_type = 'signup' OR (event_type = 'click' AND event_id % 5 <> 0)""",
    "settle_transactions": "SELECT * FROM sold",
    "settle_first_wins": f"""
        SELECT x.channel, printf('%05d', coalesce(last, 0) + row_number() OVER (PARTITION BY x.channel ORDER BY seq)) AS transaction_id,
               listing_id, account_id AS buyer_id, method AS payment_method, 0 AS status
        FROM (SELECT * FROM checked WHERE reason IS NULL AND status <> '{SOLD}' AND deleted = 0
              QUALIFY row_number() OVER (PARTITION BY channel, listing_id ORDER BY seq) = 1) x
        LEFT JOIN last_sale s ON s.channel = x.channel""",
    "settle_events": "SELECT * FROM moves",
    "settle_deltas": """
        SELECT account_id, CAST(sum(CASE kind WHEN 'debit' THEN -amount ELSE amount END) AS BIGINT) AS delta
        FROM moves GROUP BY ALL""",
    "settle_rejects": """
        SELECT seq, channel, listing_id, account_id AS buyer_id, method AS payment_method, price, claimed, reason
        FROM checked WHERE reason IS NOT NULL""",
    "settle_listings": f"SELECT DISTINCT channel, listing_id, '{SOLD}' AS status FROM checked WHERE reason IS NULL",
    "listing_state": "SELECT * FROM state",
    "sales_report": """
        SELECT s.channel, payment_method, count(*) AS n, CAST(sum(trunc(price)) AS BIGINT) AS total
        FROM sold s JOIN listing l ON l.channel = s.channel AND l.listing_id = s.listing_id GROUP BY ALL""",
    "category_drift": """
        SELECT l.channel, l.listing_id, l.category_id, s.category_id AS status_category_id
        FROM listing l JOIN category_status s ON s.channel = l.channel AND s.listing_id = l.listing_id
        WHERE l.category_id IS DISTINCT FROM s.category_id""",
    "assign_ids": """
        SELECT o_orderkey, printf('%05d', (SELECT max(CAST(address_id AS BIGINT)) FROM address)
                                          + row_number() OVER (ORDER BY o_orderkey)) AS new_id
        FROM orders""",
    "register": """
        SELECT printf('%05d', (SELECT max(account_id) FROM account) + no) AS account_id, username AS account_name,
               './static/images\\default_icon.jpg' AS icon, email, '山田' AS lastname, '花子' AS firstname,
               'ヤマダ' AS lastname_kana, 'ハナコ' AS firstname_kana,
               strftime(strptime(birthday, '%Y/%m/%d'), '%Y-%m-%d') AS birthday, gender, phone, children,
               CAST(0 AS BIGINT) AS points
        FROM accepted""",
    "register_addresses": """
        SELECT printf('%05d', (SELECT max(CAST(address_id AS BIGINT)) FROM address) + no) AS address_id,
               printf('%05d', (SELECT max(account_id) FROM account) + no) AS account_id, postal_code, prefecture,
               c_mktsegment AS city_ward, CAST(c_nationkey AS VARCHAR) AS address_number, '' AS building
        FROM accepted""",
    "list_item": f"""
        SELECT channel, printf('%05d', last_listing + no) AS listing_id, account_id AS seller_id,
               '0000' || substr(o_orderpriority, 1, 1) AS category_id, name, {_pick(CONDITIONS, 'seq')} AS condition,
               o_orderpriority AS description, price, {_pick(SHIPPING_PAYERS, 'seq')} AS shipping_payer,
               {_pick(SHIPPING_ESTIMATES, 'seq')} AS shipping_estimate,
               CASE WHEN channel = 'rental' THEN {_pick(RENTAL_PERIODS, 'seq')} END AS rental_period,
               '2024-01-01 00:00:00' AS listed_at, '{LISTED}' AS status, 0 AS deleted
        FROM listed""",
    "list_item_category": """
        SELECT channel, printf('%05d', last_status + no) AS status_id, printf('%05d', last_listing + no) AS listing_id,
               '0000' || substr(o_orderpriority, 1, 1) AS category_id
        FROM listed""",
    "list_item_photos": """
        SELECT channel, printf('%05d', (SELECT max(photo_id) FROM photo p WHERE p.channel = x.channel)
                               + row_number() OVER (PARTITION BY channel ORDER BY seq, slot)) AS photo_id,
               printf('%05d', last_listing + no) AS listing_id,
               './static/upload/' || account_id || '_' || seq || '_' || slot AS path
        FROM (SELECT *, unnest([1, 2, 3, 4]) AS slot, unnest([f1, f2, '', f4]) AS file FROM listed) x WHERE file <> ''""",
    "add_comment": """
        SELECT channel, printf('%05d', (SELECT max(comment_id) FROM comment c WHERE c.channel = f.channel)
                               + row_number() OVER (PARTITION BY channel ORDER BY seq)) AS comment_id,
               listing_id, author_id, content, 0 AS deleted
        FROM comment_form f""",
    "send_dm": """
        SELECT printf('%05d', (SELECT max(dm_id) FROM dm) + row_number() OVER (ORDER BY dm_id)) AS dm_id, receiver_id,
               sender_id, content, media, '2024-01-01 00:00:00' AS sent_at, 0 AS deleted
        FROM dm""",
    "update_profile": """
        SELECT a.account_id, coalesce(p.account_name, a.account_name) AS account_name, a.icon, a.email,
               CASE WHEN p.seq IS NULL THEN a.phone ELSE p.phone END AS phone, coalesce(p.children, a.children) AS children,
               a.points
        FROM account a LEFT JOIN profile_latest p ON p.account_id = a.account_id""",
    "update_address": """
        SELECT a.address_id, a.account_id, coalesce(p.postal_code, a.postal_code) AS postal_code,
               coalesce(p.prefecture, a.prefecture) AS prefecture, coalesce(p.city_ward, a.city_ward) AS city_ward,
               coalesce(p.address_number, a.address_number) AS address_number,
               CASE WHEN p.seq IS NULL THEN a.building END AS building
        FROM address a LEFT JOIN profile_latest p ON p.account_id = a.account_id""",
    "valid_profile": "SELECT seq, account_id, errors FROM profile_checked",
    "edit_sale": _edited("sale", _EDIT),
    "edit_rental": _edited("rental", [*_EDIT, "category_id", "rental_period"]),
    "edit_sale_category": _edited_category("sale"),
    "edit_rental_category": _edited_category("rental"),
    "valid_edit": """
        SELECT event_id AS seq, CASE WHEN event_id % 9 <> 4 THEN CAST(floor(value * 100) AS BIGINT) END AS price,
               CASE WHEN event_id % 9 = 4 THEN 'price:number' ELSE '' END AS errors
        FROM events WHERE event_type = 'error'""",
    "replace_photos": """
        SELECT p.channel, p.photo_id, p.listing_id, coalesce(u.path, p.path) AS path
        FROM photo p LEFT JOIN photo_upload u ON u.channel = p.channel AND u.listing_id = p.listing_id""",
    "replace_icon": """
        SELECT account_id, icon, replace(icon, './static/', '') AS public_icon
        FROM (SELECT a.account_id, CASE WHEN u.event_id IS NULL THEN a.icon
                     ELSE './static/upload/' || a.account_id || '_icon' || u.event_id || '.JPG' END AS icon
              FROM account a LEFT JOIN icon_upload u ON u.account_id = a.account_id)""",
    "valid_registration": "SELECT * FROM registration_errors",
    "valid_listing": """
        SELECT seq, errors, price, lower(regexp_extract(f2, '[^.]*$')) AS extension2,
               CAST((f1 <> '') AS BIGINT) + CAST((f2 <> '') AS BIGINT) + CAST((f4 <> '') AS BIGINT) AS n_uploads
        FROM listing_errors""",
    "valid_post": """
        SELECT DISTINCT conv_id * 1000 + turn // 4 AS seq,
               CASE WHEN conv_id % 11 = 3 THEN 'title:required' WHEN conv_id % 13 = 4 THEN 'title:too_long' ELSE '' END AS errors
        FROM conversations""",
    "normalise": """
        SELECT seq, '090' || printf('%04d', seq % 10000) AS phone,
               substr(zip || seq, 1, 3) || '-' || substr(zip || seq, 4, 4) AS postal_code,
               CASE WHEN length(d) > 3 THEN substr(d, 1, 3) || '-' || substr(d, 4, 4) ELSE substr(d, 1, 7) END AS postal_part,
               CASE WHEN length(b) > 6 THEN substr(b, 1, 4) || '/' || substr(b, 5, 2) || '/' || substr(b, 7, 2)
                    WHEN length(b) > 4 THEN substr(b, 1, 4) || '/' || substr(b, 5, 2) ELSE b END AS birthday,
               CASE WHEN length(d) > 6 THEN substr(d, 1, 4) || '/' || substr(d, 5, 2) || '/' || substr(d, 7, 2)
                    WHEN length(d) > 4 THEN substr(d, 1, 4) || '/' || substr(d, 5, 2) ELSE d END AS date_part,
               '¥ ' || format('{:,}', CAST(zip AS BIGINT)) AS price, '' AS no_price
        FROM (SELECT seq, printf('%07d', seq * 37 % 10000000) AS zip, CAST(seq AS VARCHAR) AS d,
                     substr(replace(birthday, '/', ''), 1, 8) AS b
              FROM registration)""",
    "postal_enrich": """
        SELECT account_id, postal_code, p.prefecture AS postal_prefecture, p.city AS postal_city, p.town AS postal_town,
               CASE WHEN postal_code = '' THEN 'missing' WHEN p.zipcode IS NULL THEN 'not_found' ELSE 'ok' END AS postal_status
        FROM address a LEFT JOIN postal p ON p.zipcode = replace(a.postal_code, '-', '')""",
    "stored_sales": "SELECT CAST(listing_id AS VARCHAR) AS saleId, name AS productName, status AS listingStatus FROM listing WHERE channel = 'sale'",
    "appended_comments": """
        SELECT CAST(comment_id AS VARCHAR) AS saleCommentId, CAST(listing_id AS VARCHAR) AS saleId, content AS productCommentContent
        FROM comment WHERE channel = 'sale'""",
    "committed_tables": """
        SELECT a.account_id, a.account_name || '!' AS account_name, d.postal_code
        FROM account a LEFT JOIN address d ON d.account_id = a.account_id""",
    "split_lists": """
        SELECT conv_id, turn, CAST(len(string_split(text, ',')) AS INT) AS n, string_split(text, ',')[1] AS first_item
        FROM conversations WHERE text <> ''
        UNION ALL SELECT conv_id, turn, 0, NULL FROM conversations WHERE text = '' OR text IS NULL""",
    "stream_points": "SELECT account_id, points FROM last_balance",
    "stream_listing_state": "SELECT * FROM state",
    "stream_settle": "SELECT * FROM sold",
    "stream_settle_events": "SELECT * FROM moves",
    "stream_settle_listings": f"SELECT DISTINCT channel, listing_id, '{SOLD}' AS status FROM checked WHERE reason IS NULL",
    "stream_settle_rejects": """
        SELECT seq, channel, listing_id, account_id AS buyer_id, method AS payment_method, price, claimed, reason
        FROM checked WHERE reason IS NOT NULL""",
    "stream_points_opening": """
        SELECT account_id, balance AS points FROM replay_opened
        QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY rn DESC) = 1""",
    # Every follow that finds no edge gets the next id.
    "stream_follow": """
        SELECT f.followed_id, f.follower_id, arg_max(i.id, i.seq) AS follow_id
        FROM follow f JOIN (
            SELECT *, printf('%05d', row_number() OVER (ORDER BY seq)) AS id
            FROM (SELECT *, lag(action) OVER (PARTITION BY followed_id, follower_id ORDER BY seq) AS prev FROM follow_log)
            WHERE action = 'follow' AND (prev IS NULL OR prev = 'unfollow')) i USING (followed_id, follower_id)
        GROUP BY ALL""",
    "stream_registration": "SELECT * FROM registration_errors",
    "stream_window_counts": f"""
        SELECT strftime(date_trunc('hour', ts), {_SHOWN}) AS window_start, event_type AS kind, count(*) AS n
        FROM events GROUP BY ALL""",
    # The feed comes in three parts; a row is late by the newest time of the parts before its own.
    "stream_window_late": """
        WITH p AS (SELECT *, event_id % 3 AS part FROM events),
        m AS (SELECT part, max(ts) AS newest FROM p GROUP BY part)
        SELECT event_id, event_type AS kind FROM p
        WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(newest) FROM m WHERE m.part < p.part) - INTERVAL 1 DAY""",
}

_BODIES["lookup_listing"] = f"SELECT * FROM ({_BODIES['item_detail']}) x WHERE channel = 'sale' AND listing_id = 7"
_BODIES["lookup_account"] = f"SELECT * FROM ({_BODIES['account_profile']}) x WHERE account_id = 7"
_BODIES["lookup_seller"] = f"SELECT * FROM ({_BODIES['seller']}) x WHERE seller_id = 7"
_BODIES["lookup_post"] = f"SELECT * FROM ({_BODIES['post_html']}) x WHERE post_id = 7"

ORACLE = {name: _sql(body) for name, body in _BODIES.items()}
