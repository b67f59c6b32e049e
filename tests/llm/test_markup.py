import pytest

from bullgauge.llm import markup

CASES = {
    "<p class=a>沪铜</p>": "html", "a<br/>b": "html", "x <!-- ad --> y": "html", "行情&nbsp;回顾": "html", "&#65292;": "html", "<o:p>x": "html",
    "## 标题": "markdown", "**重点**内容": "markdown", "`代码`": "markdown", "~~删~~": "markdown", "> 引文": "markdown", "- [ ] 任务": "markdown", "| 品种 | 收盘 |\n|---|---|\n| 铜 | 1 |": "markdown", "![图](http://a.b/c.png)": "markdown", "[图5](https://a.b/c)": "markdown", "```\nx = 1\n```": "markdown",
    "== 标题 ==": "wiki", "'''粗'''体": "wiki", "[[焦煤|链接]]": "wiki", "{{模板|值}}": "wiki",
    "\\section{标题}": "latex", "下跌 4.2\\%": "latex", "\\textbf{重}": "latex", "$\\frac{a}{b}$": "latex", "\\begin{itemize}": "latex",
}
PLAIN = ["【有色】沪铜", "一、沪铜", "库存<605 万吨且利润>14% 时", "报价 $2,985/吨，到岸 $2,734", "D:\\desk\\out13 与 tmp_sheet_2.xls", "[注8] 样本", "- 29 -", "第 3 页", ">>> 上一篇 | 下一篇", "甲&乙两组，Müller & Søn", "{甲组} 与 {乙组}", "a_i 与 b_i 之差 ~0.4", "量比 3*4=见表，以 5 - 3 - 2", "==========", "----------", "Research | For clients only", "", None]


@pytest.mark.parametrize(("text", "kind"), CASES.items())
def test_kinds(text, kind):
    assert kind in markup.kinds(text)


@pytest.mark.parametrize("text", PLAIN)
def test_plain_typography(text):
    assert markup.kinds(text) == [] and markup.plain_text(text) is text


def test_structure_stays():
    out = markup.plain_text("<h2>沪铜</h2><p>去化 <b>明显</b></p><ul><li>一</li><li>二</li></ul><table><tr><td>a</td><td>b</td></tr></table><pre>x = 1</pre><script>no()</script>")
    assert out.split("\n") == [x for x in out.split("\n")] and "# 沪铜" in out and "去化 明显" in out and "- 一\n- 二" in out and "a | b" in out and "    x = 1" in out and "no()" not in out
    assert markup.plain_text("== 沪铜 ==\n* 一\n'''粗'''") == "# 沪铜\n- 一\n粗"
    assert markup.plain_text("\\section{沪铜}\n$\\frac{a}{b}$ 下跌 4\\%") == "# 沪铜\n$\\frac{a}{b}$ 下跌 4%"
    assert "    x = 1" in markup.plain_text("```\nx = 1\n```")


def test_lines_stay_for_comparison():
    t = "<div>\n<p>a</p>\n<!-- x\ny -->\n## b\n| c | d |\n|--|--|\n"
    assert markup.plain_text(t, marks=False).count("\n") == t.count("\n")


def test_tag_paths():
    found = markup.nodes("<nav><a>首页</a></nav><div><p>很长的一段正文，有标点。再来一句，更长一些。</p></div><style>x{}</style>")
    kept = markup.content_paths(found)
    assert "root/div/p" in kept and "root/style" not in kept


def test_degenerate():
    for t in ("<" * 5000, "<p>" * 3000, "*" * 5000, "\\" * 5000, "[" * 3000, "_ " * 3000, "{{" * 2000):
        markup.plain_text(t)


MENU = '<div class="menu"><a>首页</a><a>关于</a><a>联系</a></div>'
BODY = "<div><p>很长的一段正文，有标点。再来一句，更长一些，还有<a>链接</a>。</p></div>"


def test_the_ratio_decides():
    out = markup.plain_text(MENU + BODY)
    assert "首页" not in out and "联系" not in out and "还有链接。" in out
    assert markup.plain_text("- [首页](/a)\n- [关于](/b)\n正文一段，有标点，写得很长很长，所以留下来。") == "正文一段，有标点，写得很长很长，所以留下来。"


def test_paths_of_every_dialect():
    for text, path in {"## a": "root/md:h2", "- **a** b": "root/md:li/md:strong", "== a ==": "root/wiki:h", "[[a|b]]": "root/wiki:a", "\\section{a}": "root/tex:h", "x $\\frac{a}{b}$": "root/tex:math", "a&nbsp;b": "root/entity", "<p>a<b>c": "root/p/b", "<p>a<p>b": "root/p", "<!-- x -->": "root/comment"}.items():
        assert path in {p for p, _ in markup.nodes(text)}, text
    assert all(not markup.is_marked(markup.nodes(t)) for t in PLAIN if t)


def test_deep_nesting():
    found = markup.nodes("<div>" * 5000 + "x" + "</div>" * 4999 + "y")
    paths = [p for p, t in found if t in ("x", "y")]
    assert max(map(len, paths)) < 1000 and paths[1] == "root/div"


def test_ratios_of_all_documents_of_a_source(spark):
    """The operator in SQL against the same in Python; a path is judged by its source's documents, not by one document's."""
    from bullgauge.llm import repair

    rows = [(k, k % 3 if k % 7 else None, (MENU if k % 2 else "") + f"<div><p>正文{k}，有标点。</p></div>" + ("<span>短</span>" if k % 5 == 0 else "")) for k in range(40)]
    rows += [(100, 1, MENU), (101, 1, None), (102, 1, ""), (103, 1, "无标记"), (104, None, "<a>x</a>")]
    df = spark.createDataFrame(rows, "id long, path long, text string")  # a clashing name
    got = {r.key: r.text for r in repair.strip_markup(df, "id", "text", "path").collect()}
    counts = {}
    for _, s, t in rows:
        if t:
            for p, c in markup.statistics(markup.nodes(t)).items():
                mine = counts.setdefault(s, {}).setdefault(p, [0] * 4)
                mine[:] = [a + b for a, b in zip(mine, c)]
    want = {k: markup.plain_text(t, dropped=markup.dropped_paths(counts[s])) for k, s, t in rows if t and markup.is_marked(markup.nodes(t))}
    assert got == want and "首页" not in got[1] and got[100].strip() == ""


def test_commands_in_commands():
    assert markup.plain_text("\\textbf{a \\emph{b {c} d} e} \\{f\\}") == "a b {c} d e {f}"
    assert markup.plain_text("\\textbf{a") == "\\textbf{a"
    deep = markup.plain_text("\\textbf{" * 3000 + "x" + "}" * 3000)
    assert deep == "x"
