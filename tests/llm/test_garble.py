"""Wrong encodings: exact round trips, mixed lines, decoys, degenerate input."""

import pytest

from bullgauge.llm import garble

TEXT = "盘面：受环保限产影响，沪铜隔夜减仓运行，报收 79,666 元/吨。"


def spoil(text: str, written: str, read: str) -> str:
    raw = text.encode(written)
    if read == "cp1252":
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in raw)
    return raw.decode(read, "replace")


@pytest.mark.parametrize(("written", "read"), [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("gbk", "cp1252"), ("gbk", "latin-1"), ("utf-8", "cp1251")])
def test_round_trip(written, read):
    bad = spoil(TEXT, written, read) if read != "cp1251" else "".join(bytes([b]).decode("cp1251", "ignore") or chr(b) for b in TEXT.encode())
    assert garble.repair_line(bad) == (TEXT, True)


def test_read_twice():
    assert garble.repair_line(spoil(spoil(TEXT, "utf-8", "cp1252"), "utf-8", "cp1252")) == (TEXT, True)


@pytest.mark.parametrize(("written", "read"), [("utf-8", "gbk"), ("gbk", "big5")])
def test_lossy_pairs_come_back_for_the_most_part(written, read):
    new, hit = garble.repair_line(spoil(TEXT, written, read))
    assert hit and sum(a in new for a in TEXT) >= 0.85 * len(TEXT)


def test_lost_text_is_a_case():
    new, hit = garble.repair_line(spoil(TEXT, "gbk", "utf-8"))
    assert hit and new


def test_only_the_span_changes():
    line = "正常文字 " + spoil("沪铜上涨", "utf-8", "cp1252") + " naïve café「値上がり」"
    assert garble.repair_line(line) == ("正常文字 沪铜上涨 naïve café「値上がり」", True)


def test_letter_in_a_name():
    assert garble.repair_line("stocks near KÃ¼strand changed") == ("stocks near Küstrand changed", True)


@pytest.mark.parametrize("line", ["俄文原文为 «цены на медь»，译为铜价。", "日方备忘录写作「値上がり」，折 ¥129。", "报价来自 Müller & Søn 询价单，约 €673。", "龘靐等生僻字号船舶共 9 艘。", "温度降至 -13°C，Brännvik 港口封冻。", "棕榈油、碳酸锂与澹川的煤·贸易", "plain ascii", ""])
def test_decoys(line):
    assert garble.repair_line(line) == (line, False)


def test_null_empty_long():
    assert garble.repair_text(None) == (None, False) and garble.repair_text("") == ("", False)
    long = "中文" * 200_000
    assert garble.repair_text(long) == (long, False)
    new, hit = garble.repair_text("好\n" + spoil("沪铜", "utf-8", "cp1252") + "\n\r\n")
    assert hit and new == "好\n沪铜\n\r\n"


def test_single_quotes():
    assert garble.repair_line("Tap ¡°Read more¡± to open") == ("Tap “Read more” to open", True)
    assert garble.repair_line("Tap вЂњRead moreвЂќ to open") == ("Tap “Read more” to open", True)


TRADITIONAL = "滬銅庫存續降，價格上漲"
EVERY = [
    (TRADITIONAL, "big5", "cp1252"), ("цены на медь растут", "utf-8", "cp1252"), (TRADITIONAL, "utf-8", "cp1252"), ("銅の在庫が減少", "utf-8", "cp1252"), ("구리 재고 감소", "utf-8", "cp1252"), ("ราคาทองแดง", "utf-8", "cp1252"),
    (TEXT, "gbk", "cp1251"), (TEXT, "utf-8", "cp437"), (TEXT, "utf-8", "koi8_r"), (TRADITIONAL, "big5", "cp1251"), (TEXT, "gbk", "cp437"), ("naïve café «x»", "utf-8", "cp1252"), ("β 系数", "utf-8", "cp1252"),
]


@pytest.mark.parametrize(("text", "written", "read"), EVERY)
def test_every_pair(text, written, read):
    """What was written comes back, not what another code makes of the same bytes."""
    raw = text.encode(written)
    bad = "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in raw) if read in ("cp1252", "cp1251") else raw.decode(read)
    assert garble.repair_line(bad) == (text, True)


@pytest.mark.parametrize("line", ["цены на медь растут быстро", "Рёв и Сёмга, «Её»", "voilà\xa0» dit-il", "Ελληνικά κείμενο", TRADITIONAL, "銅の在庫", "Đường giá", "5×\xa010 ×‘x’", "┌──┐│表│", "température élevée à «Genève»"])
def test_real_words_of_other_languages_stay(line):
    assert garble.repair_line(line) == (line, False)


def test_read_twice_in_two_ways():
    for text in ("每日策略速递 15 成以内。", "更多晨会录音请下载穹台期货移动端"):
        assert garble.repair_line(spoil(spoil(text, "utf-8", "cp1252"), "utf-8", "cp1252")) == (text, True)
