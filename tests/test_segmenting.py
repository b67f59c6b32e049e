from bullgauge.operators.segmenting import advice_of, blocks, is_legal, products_of, segment


def codes(text):
    return [s["product_code"] for s in segment(text)]


def test_single_block():
    s = segment("【有色】沪铜\n库存持续去化。\n操作建议：逢低偏多，关注支撑。")
    assert [(x["product_code"], x["product_name"], x["sector"], x["seq"]) for x in s] == [("CU", "沪铜", "有色", 0)]
    assert "逢低偏多" in s[0]["advice_text"]


def test_heading_with_own_paragraphs():
    s = segment("【有色】沪铜、沪铝\n沪铜：库存去化，操作建议：逢低偏多。\n沪铝：成本塌陷，操作建议：逢高沽空。\n【黑色】螺纹钢\n需求回落。操作建议：观望为主。")
    assert [x["product_code"] for x in s] == ["CU", "AL", "RB"]
    assert "逢低偏多" in s[0]["advice_text"] and "逢高沽空" in s[1]["advice_text"]
    assert not any(x["raw_text"].startswith("[") for x in s)


def test_heading_that_cannot_be_split():
    s = segment("【贵金属】沪金沪银\n昨日沪金沪银同步走强，避险升温。\n操作建议：暂不看空。\n【黑色】螺纹钢\n操作建议：观望为主。")
    assert [x["product_code"] for x in s] == ["AU", "AG", "RB"]
    assert s[0]["raw_text"].startswith("[多品种合并块") and s[0]["raw_text"] == s[1]["raw_text"]
    assert not s[2]["raw_text"].startswith("[")


def test_macro_block_and_title():
    s = segment("【宏观】市场综述\n今日原油领涨，商品普遍走强，资金流入明显，情绪回暖，原油再创新高。操作建议：谨慎逢低偏多。\n【有色】沪铜\n操作建议：逢高沽空。")
    assert [x["product_code"] for x in s] == [None, "CU"]


def test_legal_text():
    s = segment("【能化】原油\n供应收缩，库存去化明显，关注后续。\n操作建议：逢高沽空。\n【黑色】螺纹钢\n操作建议：逢低偏多。\n\n免责声明：本报告不构成投资建议，据此操作，风险自担。")
    assert "逢高沽空" in s[0]["advice_text"] and "风险" not in s[1]["raw_text"]
    assert is_legal("以上内容仅供参考") and not is_legal("谨慎逢低偏多，关注支撑")


def test_preamble():
    head = "某某期货 商品日报\n发布日期：2026-09-09\n"
    assert codes(head + "【沪铜】\n操作建议：逢低偏多。\n【沪铝】\n操作建议：观望为主。") == ["CU", "AL"]
    long = "今日商品整体走强，资金流入明显，板块之间分化加剧，黑色系领涨而农产品偏弱，市场情绪继续回暖，成交放大，夜盘延续升势，关注节前备货与宏观数据的指引。"
    assert codes(head + long + "\n【沪铜】\n操作建议：逢低偏多。\n【沪铝】\n操作建议：观望为主。") == [None, "CU", "AL"]


def test_levels_of_headings():
    assert len(blocks("【沪铜】\n1、供应\n2、需求\n【沪铝】\nx")) == 2
    assert [b.anchor for b in blocks("## 沪铜\na\n## 沪铝\nb")] == ["沪铜", "沪铝"]
    assert [b.anchor for b in blocks("一、沪铜\na\n二、沪铝\nb")] == ["沪铜", "沪铝"]
    assert len(blocks("沪铜走强。\n库存去化。\n沪铝走弱。")) == 2


def test_body_products():
    from bullgauge.operators.segmenting import Block

    assert products_of(Block("", "市场走强。能化受原油拖累。收盘回落。")) == ((), False)
    assert products_of(Block("", "沪铜走强。收盘回落。")) == (("CU",), False)
    assert products_of(Block("", "市场走强。沪铜走强。沪铜回落。")) == (("CU",), False)
    assert products_of(Block("", "沪铜沪铝沪锌沪镍普涨。")) == ((), False)


def test_same_product_twice_is_one_segment():
    s = segment("【沪铜】上期\n操作建议：逢高沽空。\n【沪铝】\n操作建议：观望为主。\n【沪铜】本期\n操作建议：逢低偏多。")
    assert [x["seq"] for x in s] == [0, 1] and "上期" in s[0]["raw_text"] and "本期" in s[0]["raw_text"] and "逢低偏多" in s[0]["advice_text"]


def test_advice():
    assert "逢低偏多" in advice_of("昨日操作建议：逢高沽空（已失效）。最新情况：库存快速去化。操作建议：逢低偏多，关注 78,100 一线支撑。")
    assert "偏多思路为主" in advice_of("建议关注库存变化。观点：偏多思路为主。")
    assert advice_of("操作建议：逢低偏多。本报告不构成投资建议。") == "逢低偏多。"
    assert "偏多思路" in advice_of("昨日沪铜收涨。库存持续去化。整体仍以偏多思路对待。")
    assert "逢低偏多" in advice_of("操作建议：谨慎。仓位上以逢低偏多为主。")


def test_empty():
    assert segment(None) == segment("") == segment("  \n ") == []
