import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import pii

NAMES = pii.Names(frozenset({"mira", "elin", "若岚", "知秋棠"}), frozenset({"velmoor", "hallquist-brae", "纪", "司徒"}))
CIPHER = pii.Cipher(b"key")
FOUND = [
    ("Write to me at o.sric+x@mail.example if", ["email"]),
    ("contact: <OSRIC-57@corp.example.com>", ["email"]),
    ("osric42(at)example.org,", ["email"]),
    ("osric [at] post [dot] example ok", ["email"]),
    ("osric_59 at corp dot example dot com They", ["email"]),
    ("邮箱：osric＠uni.example～", ["email"]),
    ("tel 199-0000-2487", ["phone"]),
    ("电话：19900007917，白天", ["phone"]),
    ("+86 198 0000 4301!", ["phone"]),
    ("0049 30 23125942", ["phone"]),
    ("+1 (212) 555-0110", ["phone"]),
    ("415.555.0140。", ["phone"]),
    ("07700 900 911 ab 18 Uhr", ["phone"]),
    ("打一九八〇〇〇〇六〇五二找我", ["phone"]),
    ("身份证：994652 19990506 3640", ["id_number"]),
    ("身份证：994652 19990506 3641", []),
    ("ID no. 921-59-5147 was", ["id_number"]),
    ("QQ 84 73 90 C", ["id_number"]),
    ("I live at Flat 13, 95 Tannery Row, Greywater 12345, same", ["address"]),
    ("72 Ferrygate, Eastmere", ["address"]),
    ("Mühlgasse 206a, 34119 Eastmere", ["address"]),
    ("我家就在临溪县柳堤区晴川大道143号22栋479，离得近", ["address"]),
    ("Thanks to Mira Velmoor!", ["person"]),
    ("Velmoor, Mira", ["person"]),
    ("Elin K. Hallquist-Brae from", ["person"]),
    ("mira velmoor老师", ["person"]),
    ("这段是司徒若岚讲的吧", ["person"]),
    ("感谢纪知秋棠推荐", ["person"]),
    ("Mi​ra Velmoor", ["person"]),
    ("12 Mill Lane is mine, mail a@b.example, Mira Velmoor", ["email", "address", "person"]),
]
NOTHING = [
    "logo@2x.png in the pack", "Set meta@name to 24", "Ask @nightreader70 or #ep49", "订单号 2024678800151 一直没发货", "Lot 994435196208239866 is gone.",
    "ISBN 978-0-00-551400-0 is what I read.", "My score was 11-52-31 in the quiz.", "I use v39.52.1", "Paid 166 000 000 in play money", "起拍价1660000元",
    "柳堤路那首歌比石桥巷好听", "better than the Heron Close one", "Weaver Street Radio", "The tiny otter", "Mira said so", "Dear Velmoor", "mira.velmoor", "At 12:30 Paris slept.", "", "12345",
]


def kinds(text):
    return pii.pseudonymised(text, NAMES, CIPHER)[1]


def test_found_and_not_found():
    assert [(t, kinds(t)) for t, k in FOUND if kinds(t) != k] == []
    assert [(t, kinds(t)) for t in NOTHING if kinds(t)] == []


def test_valid_id_keeps_its_format():
    body = "99465219990506364"
    number = body + pii._check_digit(body)
    clean, found = pii.pseudonymised(f"ID {number}.", NAMES, CIPHER)
    m = re.fullmatch(r"ID \[ID_NUMBER ([0-9X]{18})\]\.", clean)
    assert found == ["id_number"] and m and m[1] != number and pii.id_check(m[1])


def test_equal_values_are_linked():
    one = lambda t: re.search(r"\[[^\]]*\]", pii.pseudonymised(t, NAMES, CIPHER)[0])[0]
    assert one("a@b.example") == one("<A(at)B.example>") == one("a at b dot example") != one("c@b.example")
    assert one("Mira Velmoor") == one("Velmoor, Mira") == one("Mira K. Velmoor") != one("Elin Velmoor")
    digits = lambda t: re.sub(r"\D", "", one(t))
    assert digits("19900007917") == digits("199-0000-7917") == digits("一九九〇〇〇〇七九一七") != digits("19900007918")
    assert pii.pseudonymised("a@b.example", NAMES, pii.Cipher(b"other"))[0] != pii.pseudonymised("a@b.example", NAMES, CIPHER)[0]


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 100_000).flatmap(lambda n: st.tuples(st.just(n), st.integers(0, n - 1))))
def test_round_trip(pair):
    n, value = pair
    moved = CIPHER.permute(value, n, "t")
    assert 0 <= moved < n and CIPHER.restore(moved, n, "t") == value


@pytest.mark.parametrize("n", [2, 3, 7, 100, 1000])
def test_permutation(n):
    assert sorted(CIPHER.permute(v, n, "t") for v in range(n)) == list(range(n))


def test_the_rest_stays_readable():
    text = "Hello ａ＠ｂ.example, see ② — 👩‍💻 " * 2000
    clean, _ = pii.pseudonymised(text, NAMES, CIPHER)
    assert re.sub(r"\[EMAIL [0-9a-f]+\]", "ａ＠ｂ.example", clean) == text


def test_table(spark):
    rows = [(1, "body", "Mira Velmoor", "clash"), (2, "body", None, ""), (3, "user", "Mira Nobody", ""), (4, "body", "", ""), (1, "body", "Mira Velmoor", "clash")]
    df = spark.createDataFrame(rows, "id int, slot string, text string, _found string")
    out = pii.replace(df, NAMES, b"key")
    assert out.columns == [*df.columns, "clean", "kinds"]
    got = {r.id: (r.clean, r.kinds) for r in out.collect()}
    assert got[2] == (None, []) and got[3][1] == ["person"] and got[4] == ("", []) and got[1][1] == ["person"]
    assert pii.replace(df.limit(0), NAMES, b"key").count() == 0


def test_learned_names(spark):
    users = [("Mira Szarvane",), ("Elin Szarvane",), ("Odile Szarvane",), ("Odile Velmoor",), ("Happy Panda",), ("纪书遥",), ("司徒书遥",), ("佘若岚",), ("佘知秋棠",), (None,), ("Mira Once",)]
    parts = [("given", x) for x in ("Mira", "Elin", "若岚", "知秋棠")] + [("family", x) for x in ("Velmoor", "纪", "司徒")]
    names = pii.learn_names(spark.createDataFrame(users, "user_name string"), spark.createDataFrame(parts, "part_role string, name_part string"))
    assert names.family == {"velmoor", "纪", "司徒", "szarvane", "佘"} and names.given == {"mira", "elin", "若岚", "知秋棠", "odile", "书遥"}


def test_query(spark, tiny):
    from paperloom.llm import queries

    rows = queries.p4_found(spark, tiny)
    assert rows.columns == ["comment_id", "slot", "pii_kind"] and rows.count() > 10


def test_support_stays_and_many_parts_are_joined(spark):
    users = [("Mira Szarvane",), ("Elin Szarvane",), ("佘若岚",), ("佘知秋棠",), *((f"Mira {chr(65 + i)}once",) for i in range(9))]
    parts = [("given", x) for x in ("Mira", "Elin", "若岚", "知秋棠")] + [("family", x) for x in ("Velmoor", "纪", "司徒")]
    learn = lambda bound: pii.learn_names(spark.createDataFrame(users, "user_name string"), spark.createDataFrame(parts, "part_role string, name_part string"), bound=bound)
    few, many = learn(100), learn(2)
    assert isinstance(few, pii.Names) and "szarvane" in few.family and "佘" in few.family and not isinstance(many, pii.Names)
    texts = [t for t, _ in FOUND] + NOTHING + ["Thanks to Mira Szarvane!", "szarvane, elin", "这段是佘若岚讲的", "ämira szarvaneö", "Mira Szarvane-Brae", "x-mira szarvane", "Mi​ra Sz​arvane老师", None]
    df = spark.createDataFrame([(i, "user" if i % 2 else "body", t, i) for i, t in enumerate([*texts, *texts[:3], "Nobody Szarvane", "Nobody Szarvane", "佘大宝"])], "id int, slot string, text string, _found int")
    one, two = ({r.id: (r.clean, r.kinds) for r in pii.replace(df, names, b"key").collect()} for names in (few, many))
    assert one == two and len(two) == df.count()
    assert {df_id for df_id, (_, k) in two.items() if "person" in k} >= {len(texts) - 8 + i for i in range(4)}
    assert pii.replace(df, many, b"key").columns == [*df.columns, "clean", "kinds"]


SAME = [
    ("+1 415 555 2671", "+14155552671", "(415) 555-2671"),
    ("+7 912 345 67 89", "+79123456789"),
    ("+86 138 0013 8000", "13800138000", "138-0013-8000"),
    ("+44 20 7946 0958", "020 7946 0958", "0044 20 7946 0958"),
    ("+49 30 23125942", "0049 30 23125942"),
]


@pytest.mark.parametrize("writings", SAME)
def test_writings_of_a_number_are_linked(writings):
    numbers = set()
    for w in writings:
        clean, found = pii.pseudonymised(f"tel {w} now", NAMES, CIPHER)
        shown = re.fullmatch(r"tel \[PHONE (.*)\] now", clean)[1]
        assert found == ["phone"] and len(shown) == len(w) and re.sub(r"\d", "", shown) == re.sub(r"\d", "", w)
        country, places = pii.phone_parts(shown)
        numbers.add((country, "".join(shown[i] for i in places)))
        assert shown != w
    assert len(numbers) == 1


def test_identity_numbers_stay_valid():
    ids = {f"{a:03d}-{g:02d}-{n:04d}" for a in range(1, 600, 7) for g in (1, 50, 99) for n in range(1, 9999, 97)}
    ids = {i for i in ids if pii.id_check(i)}
    moved = {pii.pseudonym("id_number", i, CIPHER)[11:-1] for i in ids}
    assert len(moved) == len(ids) > 20_000 and all(map(pii.id_check, moved))
    assert all("3" <= pii.pseudonym("phone", f"138{n:08d}", CIPHER)[8] <= "9" for n in range(0, 10**8, 10**6))
