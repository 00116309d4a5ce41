"""A folder with every format, imported twice."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from chronicle.plans.imports import import_folder
from chronicle.sources.classify import classify_exports
from chronicle.sources.connectors import Connector, Options, connectors


@pytest.fixture
def exports(tmp_path):
    root = tmp_path / "exports"
    root.mkdir()
    (root / "WhatsApp Chat with Nora Vale.txt").write_text(
        "05/02/2025, 08:00 - Nora Vale: first\n05/02/2025, 08:01 - Me Self: second\nand more\n", encoding="utf-8"
    )
    with zipfile.ZipFile(root / "WhatsApp Chat - Oto.zip", "w") as archive:
        archive.writestr("_chat.txt", "[06.02.2025, 09:10:11] Oto: inside\r\n")
        archive.writestr("photo.jpg", "x")
    play = {"endTime": "2025-02-07 10:00", "artistName": "Quiet Pines", "trackName": "Low Tide", "msPlayed": 61000}
    (root / "StreamingHistory_music_0.json").write_text(json.dumps([play, play]))
    visit = {"title": "A page", "url": "https://pages.example/a", "time_usec": 1738900000000000, "page_transition": "LINK"}
    (root / "History.json").write_text(json.dumps({"Browser History": [visit]}))
    watched = {"header": "YouTube", "title": "Watched a tide", "time": "2025-02-08T10:00:00Z", "products": ["YouTube"]}
    (root / "MyActivity.json").write_text(json.dumps([watched]))
    (root / ".bash_history").write_text("#1738990000\nls -la\n#1738990060\ncd /tmp\n")
    header = "Type,Product,Started Date,Completed Date,Description,Amount,Fee,Currency,State,Balance"
    line = "CARD_PAYMENT,Current,2025-02-09 11:00:00,2025-02-09 12:00:00,Corner Bakery,-3.50,0.00,EUR,COMPLETED,10.00"
    (root / "statement.csv").write_text(f"{header}\n{line}\n")
    (root / "notes.md").write_text("nothing to import\n")
    return str(root)


def test_every_format_is_routed_and_stored_once(spark, exports, tmp_path, rows):
    warehouse = str(tmp_path / "warehouse")
    options = Options(tz="Europe/Bucharest", self_identities=("Me Self",))
    first = rows(import_folder(spark, exports, warehouse, options).orderBy("connector"))
    assert first == [
        ("bank_csv", "transactions", 1, 1, 1, 0),
        ("google_takeout", "events", 2, 2, 2, 0),
        ("shell_history", "events", 1, 2, 2, 0),
        ("spotify", "media_plays", 1, 2, 2, 0),
        ("whatsapp", "messages", 2, 3, 3, 0),
    ]
    again = rows(import_folder(spark, exports, warehouse, options).orderBy("connector"))
    assert [r[3] for r in again] == [r[3] for r in first] and {r[4] for r in again} == {0}
    texts = {r[0] for r in spark.read.parquet(f"{warehouse}/messages").select("text").collect()}
    assert texts == {"first", "second\nand more", "inside"}
    assert spark.read.parquet(f"{warehouse}/imports").filter("status = 'succeeded'").count() == 10


def test_unknown_files_and_failing_detectors_rank_at_zero(spark, exports, tmp_path, rows):
    def broken(path, text):
        raise RuntimeError("no detector")

    found = dict(rows(classify_exports(spark, exports).filter("rank = 1 AND confidence > 0").select("path", "format")))
    assert "notes.md" not in found and found["WhatsApp Chat - Oto.zip/_chat.txt"] == "whatsapp"
    extra = (Connector("aaa", "events", broken, lambda files, options: None),)
    done = import_folder(spark, exports, str(tmp_path / "other"), extra=extra)
    assert "aaa" not in {r["connector"] for r in done.collect()}
    with pytest.raises(ValueError):
        connectors((extra[0], extra[0]))


def test_classification_reads_only_the_heads(spark, tmp_path, rows):
    root = tmp_path / "long"
    root.mkdir()
    (root / "a.txt").write_text("x\n" * 50_000 + "05/02/2025, 08:00 - Nora Vale: too late\n")
    assert rows(classify_exports(spark, str(root)).filter(F.col("confidence") > 0)) == []
