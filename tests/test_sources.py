"""Parsers of raw exports on small literal files."""

import json

import pytest
from pyspark.sql import functions as F

from chronicle.sources import activity, bank, chat, classify, json_records, lines, plays, shell


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(folder)


@pytest.fixture(params=[128 << 20, 400])
def split_size(spark, request):
    """Read every file whole, and in splits of a few hundred bytes: the result is the same."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 20))
    spark.conf.set("spark.sql.files.openCostInBytes", str(4 << 20))


# One line, and the id that the row format gives it.
PINNED_CHAT = "29/03/2026, 02:59 - Alex Demo: Before the clock gap\n"
PINNED_CHAT_ID = "5872bdf655cee2cbee55d671a8a707fe"

CHAT = """30/03/2025, 02:40 - Me Self: early
30/03/2025, 03:20 - Nora Vale: in the hour that is skipped
32/03/2025, 08:00 - Nora Vale: no such day
30/03/2025, 08:61 - Nora Vale: no such minute

30/03/2025, 04:02 - Nora Vale: tide-7.jpg (file attached)
low water
at noon
30/03/2025, 04:03 - Me Self: You deleted this message
30/03/2025, 04:03 - Nora Vale: yes
30/03/2025, 04:03 - Nora Vale: yes
30/03/2025, 04:04 - +49 30 5550199: clip.mp4 (file attached)
30/03/2025, 04:05 - Missed video call
"""


def test_chat_id_format(spark, tmp_path, rows):
    folder = write(tmp_path, "WhatsApp Chat with Mira Example.txt", PINNED_CHAT)
    parsed, _ = chat.chat_messages(lines.read_lines(spark, folder), "Europe/Bucharest", ["Alex Demo"])
    assert rows(parsed, "source_row_id", "is_from_me") == [(PINNED_CHAT_ID, True)]


def test_chat_android(spark, tmp_path, rows, split_size):
    folder = write(tmp_path, "WhatsApp Chat with Nora Vale.txt", CHAT)
    parsed, refused = chat.chat_messages(lines.read_lines(spark, folder), "Europe/Bucharest", ["Me Self"])
    got = rows(
        parsed.orderBy("block", "pos"),
        "sender_name", "is_from_me", F.date_format("ts", "HH:mm"), "kind", "media_type", "text",
    )
    nora = "Nora Vale"
    assert got == [
        ("Me Self", True, "00:40", "text", None, "early"),
        (nora, False, "01:20", "text", None, "in the hour that is skipped"),
        (nora, False, "01:02", "media", "image", "low water\nat noon"),
        ("Me Self", True, "01:03", "deleted", None, None),
        (nora, False, "01:03", "text", None, "yes"),
        (nora, False, "01:03", "text", None, "yes"),
        ("+49 30 5550199", False, "01:04", "media", "video", None),
        (None, False, "01:05", "system", None, "Missed video call"),
    ]
    assert parsed.select("source_row_id").distinct().count() == len(got)
    assert rows(parsed.select("chat_kind", "chat_name").distinct()) == [("group", nora)] and refused.count() == 2


def test_chat_ios_group_in_a_hidden_file(spark, tmp_path, rows):
    text = (
        "\u200e[02.05.2025, 20:15:00] Echipa Mal: \u200ea creat grupul „Echipa Mal”\n"
        "[02.05.2025, 20:16:30] Me Self: salut\n"
        "[02.05.2025, 20:17:45] Oto Lind: 🌊\n"
    )
    folder = write(tmp_path, "_chat.txt", text)
    parsed, _ = chat.chat_messages(lines.read_lines(spark, folder, hidden=True), "Europe/Bucharest", ["Me Self"])
    got = rows(parsed.orderBy("ts"), "chat_kind", "sender_name", "kind", "is_from_me", F.date_format("ts", "HH:mm:ss"), "text")
    assert got == [
        ("group", None, "system", False, "17:15:00", "a creat grupul „Echipa Mal”"),
        ("group", "Me Self", "text", True, "17:16:30", "salut"),
        ("group", "Oto Lind", "text", False, "17:17:45", "🌊"),
    ]


def test_chat_date_orders(spark, tmp_path, rows):
    write(tmp_path, "a.txt", "1/2/24, 10:05 PM - A: month first by the clock\n")
    write(tmp_path, "b.txt", "1/2/24, 10:05 - A: day first\n13/2/24, 10:05 - A: x\n")
    folder = write(tmp_path, "c.txt", "1/2/24, 10:05 - A: month first by a field\n1/14/24, 10:05 - A: x\n")
    parsed, _ = chat.chat_messages(lines.read_lines(spark, folder))
    got = dict(rows(parsed.groupBy("path").agg(F.min(F.date_format("ts", "yyyy-MM-dd HH:mm")))))
    assert got == {"a.txt": "2024-01-02 22:05", "b.txt": "2024-02-01 10:05", "c.txt": "2024-01-02 10:05"}


def test_hidden_ranges_cover_every_line_once():
    import io

    data = b"one\ntwo\n\nthree\nfour"
    for size in range(1, len(data) + 2):
        found = []
        for start in range(0, len(data), size):
            for _, part in lines._lines_of_range(io.BytesIO(data), start, min(start + size, len(data)), b"\n", 3):
                found += part
        assert found == [b"one", b"two", b"", b"three", b"four"], size


def test_zip_members(spark, tmp_path, rows):
    import zipfile

    with zipfile.ZipFile(tmp_path / "WhatsApp Chat - Luma.zip", "w") as archive:
        archive.writestr("_chat.txt", "[13.01.2024, 18:01:01] Luma: hi\r\nthere\r\n")
        archive.writestr("photo.jpg", "x")
    parsed, _ = chat.chat_messages(lines.read_zip_lines(spark, str(tmp_path), "_chat.txt"))
    assert rows(parsed, "chat_name", "text") == [("Luma", "hi\nthere")]


def test_plays_account_layout(spark, tmp_path, rows, split_size):
    # A play, and the ids that the row format gives it and its copy.
    pinned = {"endTime": "2024-06-01 12:34", "artistName": "Fictional Lantern Ensemble", "trackName": "Fictional Orbit", "msPlayed": 180000}
    ids = {"928819cb212ba8f2dbbaa21ed15daa2c", "d9b9b3f09ac700f100f95310e1f97cc1"}
    braces = {"endTime": "2025-05-03 07:00", "artistName": 'q "}{" \\z', "trackName": "}", "msPlayed": 5.0}
    nobody = {"endTime": "2025-05-02 07:00", "artistName": None, "trackName": None, "msPlayed": 0}
    bad = [{"endTime": "2025-05-02 07:00", "msPlayed": -7}, {"endTime": "soon", "msPlayed": 2}, {"msPlayed": 2.5}]
    folder = write(tmp_path, "MyData/StreamingHistory_music_0.json", json.dumps([pinned, nobody, pinned, braces, *bad], indent=2))
    parsed, refused = plays.plays_from_json(json_records.read_json_records(spark, folder))
    got = rows(parsed.orderBy("block", "pos"), "artist", "track", "ms_played", F.col("ts").cast("string"))
    one = ("Fictional Lantern Ensemble", "Fictional Orbit", 180000, "2024-06-01 12:34:00")
    assert got == [one, (None, None, 0, "2025-05-02 07:00:00"), one, ('q "}{" \\z', "}", 5, "2025-05-03 07:00:00")]
    found = rows(parsed.orderBy("block", "pos"), "source_row_id", "media_kind")
    assert found[0][0] in ids and found[2][0] == found[0][0] and {k for _, k in found} == {"track"}
    assert refused.count() == 3
    write(tmp_path, "twice/StreamingHistory_music_0.json", json.dumps([pinned, pinned]))
    twice, _ = plays.plays_from_json(json_records.read_json_records(spark, str(tmp_path / "twice")))
    assert {r[0] for r in rows(twice, "source_row_id")} == ids


def test_plays_extended_kinds(spark, tmp_path, rows):
    base = {"ts": "2024-01-01T00:00:00Z", "ms_played": 1, "shuffle": False, "skipped": None, "conn_country": "RO"}
    records = [
        {**base, "master_metadata_track_name": "T", "audiobook_title": "B", "episode_name": "E"},
        {**base, "episode_name": "E", "episode_show_name": "S"},
        {**base, "master_metadata_track_name": "T", "master_metadata_album_artist_name": "A"},
    ]
    write(tmp_path, "Streaming_History_Audio_2024_0.json", json.dumps(records))
    folder = write(tmp_path, "Streaming_History_Video_2024.json", json.dumps(records[2:]))
    parsed, _ = plays.plays_from_json(json_records.read_json_records(spark, folder))
    got = rows(parsed.orderBy("path", "block", "pos"), "media_kind", "artist", "track", "shuffle", "skipped")
    assert got == [
        ("audiobook", "B", "T", False, None), ("episode", "S", "E", False, None),
        ("track", "A", "T", False, None), ("video", "A", "T", False, None),
    ]
    assert json.loads(parsed.first()["meta"]) == {
        "reason_start": None, "reason_end": None, "offline": None, "incognito_mode": None, "conn_country": "RO"
    }


def test_browser_history(spark, tmp_path, rows, split_size):
    # A visit, and the id that the row format gives it.
    pinned = {"title": "Synthetic stars", "url": "https://example.com/stars", "time_usec": 1704103200123456, "page_transition": "LINK"}
    other = {"title": "", "url": "https://pages.example/b", "time_usec": 1746000000000001, "page_transition": "TYPED", "extra": [1]}
    text = json.dumps({"Autofill": [{"k": {"v": 2}}], "Browser History": [pinned, other], "Typed Url": [{"u": 1}]})
    folder = write(tmp_path, "Chrome/History.json", text)
    records = json_records.read_json_records(spark, folder, member="Browser History")
    parsed, refused = activity.visits_from_json(records)
    got = rows(parsed.orderBy("block", "pos"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "title", "meta")
    assert got == [
        ("2024-01-01 10:00:00.123456", "Synthetic stars", '{"page_transition":"LINK"}'),
        ("2025-04-30 08:00:00.000001", None, '{"page_transition":"TYPED"}'),
    ]
    assert rows(parsed.orderBy("block", "pos"), "source_row_id")[0] == ("0f28f5f5fbd78815d9350af88c73c774",)
    assert refused.count() == 0


def test_activity_json(spark, tmp_path, rows):
    def entry(minute, title, header="YouTube", **more):
        time = f"2025-05-04T06:{minute:02}:00Z"
        return {"header": header, "title": title, "time": time, "products": [header], **more}

    channel = [{"name": "Harbour Films", "url": "https://video.example/harbour"}]
    records = [
        entry(1, "Watched a video that has been removed"),
        entry(2, "Watched https://video.example/x1"),
        entry(3, "Watched Slow boats", titleUrl="https://video.example/x2", subtitles=channel, details=[{"name": "From Google Ads"}]),
        entry(4, "Searched for knots"),
        entry(5, "Visited a harbour"),
        entry(6, "Searched for ?", "Search", titleUrl="https://find.example/search?x=1&q=rope%20and+sail"),
        entry(7, "Pier 4", "Maps"),
    ]
    folder = write(tmp_path, "history.json", json.dumps(records))
    parsed, refused = activity.activity_from_json(json_records.read_json_records(spark, folder))
    assert rows(parsed.orderBy("ts"), "kind", "title") == [
        ("youtube.watch", None), ("youtube.watch", None), ("youtube.watch", "Slow boats"),
        ("youtube.search", "knots"), ("google.search", "rope and sail"),
    ]
    assert sorted(r[0] for r in rows(refused, "reason")) == ["unsupported", "visited"]
    meta = json.loads(rows(parsed.orderBy("ts"), "meta")[2][0])
    assert meta == {"channel_name": "Harbour Films", "channel_url": "https://video.example/harbour", "from_ads": True}


def test_activity_id_format(spark, tmp_path, rows):
    # A watch, and the id that the row format gives it.
    pinned = {
        "header": "YouTube", "title": "Watched Synthetic stars", "titleUrl": "https://example.com/watch?v=synthetic",
        "subtitles": [{"name": "Fictional Studio", "url": "https://example.com/channel/demo"}],
        "time": "2024-01-03T10:00:00Z", "products": ["YouTube"], "details": [{"name": "From Google Ads"}],
    }
    folder = write(tmp_path, "history.json", json.dumps([pinned]))
    parsed, _ = activity.activity_from_json(json_records.read_json_records(spark, folder))
    assert rows(parsed, "source_row_id") == [("410a6bf6cf2143e802e319cc6f778579",)]


def test_activity_html(spark, tmp_path, rows, split_size):
    cell = (
        '<div class="outer-cell mdl-cell"><div class="header-cell mdl-cell"><p class="t">YouTube</p></div>'
        '<div class="content-cell mdl-cell">Watched&nbsp;<a href="https://video.example/x2">Slow &amp; steady</a>'
        '<br><a href="https://video.example/harbour">Harbour Films</a><br>{when}</div>'
        '<div class="content-cell"></div><div class="content-cell"><b>Products:</b><br>YouTube<br>From Google Ads</div></div>'
    )
    whens = ["May 4, 2025, 9:30:00 PM EEST", "some day", "5 mai 2025, 09:30:00 EEST", "06.05.2025, 11:15:30 GMT+01:00"]
    page = "<!DOCTYPE html><html><body>" + "".join(cell.replace("{when}", w) for w in whens) + "</body></html>"
    folder = write(tmp_path, "watch-history.html", page)
    parsed, refused = activity.activity_from_html(activity.read_html_cells(spark, folder), "Europe/Bucharest")
    got = rows(parsed.orderBy("ts"), "kind", "title", "url", F.col("ts").cast("string"), "meta")
    meta = '{"channel_name":"Harbour Films","channel_url":"https://video.example/harbour","from_ads":true}'
    assert got == [
        ("youtube.watch", "Slow & steady", "https://video.example/x2", when, meta)
        for when in ("2025-05-04 18:30:00", "2025-05-05 06:30:00", "2025-05-06 10:15:30")
    ]
    assert refused.count() == 1


DEBITS = """Harbour Bank
Two accounts
Date;Details;Debit;Credit;Balance;Category
07.05.2025;Net mender;12,40;;1.310,00;repairs
08.05.2025;Fish auction;;2.050,75;3.360,75;sales
END OF STATEMENT
09.05.2025;below the line;3,00;;2,00;none
"""
HEADER = "Type,Product,Started Date,Completed Date,Description,Amount,Fee,Currency,State,Balance\n"
CARDS = HEADER + """TRANSFER,Current,2025-05-07 12:00:00,,"For ""Oto"", rent
and light",-70,0.255,RON,COMPLETED,
CARD_PAYMENT,Current,2025-03-30 03:10:00,2025-03-30 03:10:00,Night kiosk,-4,0,RON,COMPLETED,90
CARD_PAYMENT,Current,2025-10-26 03:10:00,2025-10-26 03:10:00,Dawn kiosk,-6,0,RON,COMPLETED,90
CARD_PAYMENT,Current,2025-05-08 12:00:00,2025-05-08 12:00:00,Waiting,-8,0,RON,PENDING,90
CARD_PAYMENT,Current,2025-05-08 12:00:00,2025-05-08 12:00:00,No money,,0,RON,COMPLETED,90
CARD_PAYMENT,Current,2025-05-08 12:00:00,2025-05-08 12:00:00,No number,much,0,RON,COMPLETED,90
CARD_PAYMENT,Current,2025-05-08 12:00:00,2025-05-08 12:00:00,No unit,2,0,,COMPLETED,90
CARD_PAYMENT,Current,,,No day,-5,0,RON,COMPLETED,90
"""


def test_bank_statements(spark, tmp_path, rows, split_size):
    write(tmp_path, "debits.csv", DEBITS)
    folder = write(tmp_path, "cards.csv", CARDS)
    parsed, refused = bank.transactions_from_csv(lines.read_lines(spark, folder), "Europe/Bucharest")
    got = rows(parsed.orderBy("path", "ts"), F.col("amount").cast("string"), F.col("ts").cast("string"), "merchant", "kind")
    assert got == [
        # The skipped hour counts by the offset before it, the repeated one by its first pass.
        ("-4.00", "2025-03-30 01:10:00", "Night Kiosk", "card"),
        ("-70.26", "2025-05-07 09:00:00", got[1][2], "transfer"),
        ("-6.00", "2025-10-26 00:10:00", "Dawn Kiosk", "card"),
        ("-12.40", "2025-05-06 21:00:00", "Net Mender", "other"),
        ("2050.75", "2025-05-07 21:00:00", "Fish Auction", "other"),
    ]
    transfer = parsed.filter("kind = 'transfer'").first()
    assert transfer["counterparty"] is None and transfer["balance"] is None
    assert transfer["merchant_raw"] == 'For "Oto", rent\nand light'
    assert refused.count() == 4


def test_bank_id_format(spark, tmp_path, rows):
    # A record, and the id that the row format gives it.
    pinned = HEADER + "CARD_PAYMENT,Current,2024-03-31 03:30:00,2024-03-31 03:30:00,Spring gap,-1,0,RON,COMPLETED,1000\n"
    folder = write(tmp_path, "pinned.csv", pinned)
    parsed, _ = bank.transactions_from_csv(lines.read_lines(spark, folder), "Europe/Bucharest")
    assert rows(parsed, "source_row_id") == [("f48bee86d920ac8d002b381c814031f9",)]


def test_user_mapping_with_inverted_sign(spark, tmp_path, rows):
    mapping = bank.BankMapping(
        id="mine", required_headers=("When", "Memo", "Value"), ts="When", ts_format="%d/%m/%Y %H:%M",
        description="Memo", amount="Value", fee="Charge", invert=True, currency="Unit",
        account="mine:{Owner}", counterparty="Party",
    )
    text = "When,Memo,Value,Charge,Unit,Owner,Party\n05/01/2024 09:30,Lamp,12.5,0.5,EUR,me,Luma\n"
    folder = write(tmp_path, "x.csv", text)
    parsed, _ = bank.transactions_from_csv(lines.read_lines(spark, folder), mappings=(*bank.MAPPINGS, mapping))
    assert rows(parsed, F.col("amount").cast("string"), "account", "counterparty") == [("-13.00", "mine:me", "Luma")]


def test_mappings_in_other_encodings(spark, tmp_path, rows):
    def mapping(name, header, encoding):
        return bank.BankMapping(
            id=name, required_headers=(header, "Betrag"), ts=header, ts_format="%d.%m.%Y", description="Text", amount="Betrag",
            fixed_currency="EUR", account=name, delimiter=";", decimal=",", encoding=encoding,
        )

    own = (mapping("latin", "Tag-für-Tag", "latin-1"), mapping("cyrillic", "День", "cp1251"))
    write(tmp_path, "u.csv", "Date;x\n")
    (tmp_path / "l.csv").write_bytes("Tag-für-Tag;Betrag;Text\n05.01.2024;-3,50;Café Müller\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes("День;Betrag;Text\n06.01.2024;-4,00;Кофе\n".encode("cp1251"))
    parsed, refused = bank.transactions_from_csv(lines.read_lines(spark, str(tmp_path)), mappings=(*bank.MAPPINGS, *own))
    assert sorted(rows(parsed, "mapping", "merchant_raw", F.col("amount").cast("string"))) == [
        ("cyrillic", "Кофе", "-4.00"), ("latin", "Café Müller", "-3.50"),
    ]
    assert refused.count() == 0
    with pytest.raises(ValueError):
        mapping("wide", "Date", "utf-16")


def test_shell_history(spark, tmp_path, rows):
    write(tmp_path, ".zsh_history", ": 1746300010:0;make \\\n  all\nstray \\\n: 1746300020:4;echo më\n: 7:0;  \n")
    folder = write(tmp_path, "bash", "no clock yet\n#1746300015\nif true; then\n  date\nfi\n#1704067200\ngit status\n#3\n")
    parsed, refused = shell.shell_events(lines.read_lines(spark, folder, hidden=True))
    assert rows(parsed.orderBy("ts"), "title", "path") == [
        ("git status", "bash"), ("make \\\n  all", ".zsh_history"), ("if true; then\n  date\nfi", "bash"), ("echo më", ".zsh_history"),
    ]
    # Fixed value: the id that the row format gives the first command.
    assert rows(parsed.orderBy("ts"), "source_row_id")[0] == ("b9c1e9962959b4ac801ba0f84d99853e",)
    assert rows(parsed.orderBy("ts"), "meta")[3] == ('{"shell":"zsh","duration_ms":4000,"exit":null}',)
    assert refused.count() == 1


def test_zsh_escaped_bytes(spark, tmp_path, rows):
    # zsh stores bytes from 0x83 up as 0x83 and the byte xor 0x20.
    raw = "".encode()
    for byte in ": 1704067201:0;echo ăî\n".encode():
        raw += bytes([0x83, byte ^ 0x20]) if byte >= 0x83 else bytes([byte])
    (tmp_path / "history").write_bytes(raw)
    parsed, _ = shell.shell_events(lines.read_lines(spark, str(tmp_path)))
    assert rows(parsed, "title") == [("echo ăî",)]


def test_classify(spark, tmp_path, rows):
    write(tmp_path, "_chat.txt", "[13.01.2024, 18:01:01] A: hi\n")
    write(tmp_path, "notes.txt", "13/01/2024, 18:01 - A: hi\n")
    write(tmp_path, "e.csv", DEBITS)
    write(tmp_path, "r.csv", CARDS)
    write(tmp_path, "Chrome/History.json", '{"Browser History" : [{"title": "x"}]}')
    write(tmp_path, "endsong.json", "[]")
    write(tmp_path, "StreamingHistory0.json", '[{"endTime": "", "msPlayed": 1}]')
    write(tmp_path, "StreamingHistory1.json", "[]")
    write(tmp_path, "w.html", '<div class="outer-cell"><div class="content-cell">')
    write(tmp_path, ".zsh_history", ": 1:0;ls\n")
    folder = write(tmp_path, "bash", "#1\nls\n")
    best = classify.classify_exports(spark, folder).filter("rank = 1 AND confidence > 0")
    assert dict((p, (f, c)) for p, f, c in rows(best, "path", "format", "confidence")) == {
        "_chat.txt": ("whatsapp", 0.98), "notes.txt": ("whatsapp", 0.8), "e.csv": ("bank_csv", 0.95),
        "r.csv": ("bank_csv", 0.95), "Chrome/History.json": ("google_takeout", 0.95),
        "StreamingHistory0.json": ("spotify", 0.99), "StreamingHistory1.json": ("spotify", 0.6),
        "w.html": ("google_takeout", 0.95), ".zsh_history": ("shell_history", 1.0), "bash": ("shell_history", 0.95),
    }


def test_fingerprint(spark, tmp_path):
    import hashlib

    write(tmp_path, "b/two.txt", "22")
    folder = write(tmp_path, "a+ ă.txt", "1")
    expected = hashlib.sha256("a+ ă.txt\x1f1\x1eb/two.txt\x1f2\x1e".encode()).hexdigest()
    assert classify.export_fingerprint(spark, folder).first()["fingerprint"] == expected
