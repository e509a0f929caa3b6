from corpusloom.llm import markup



def test_long_formulas_are_set_aside():
    for text, kind in ((f"a $${'x+' * 3_000}y$$ b", "display"), (f"a ${'x+' * 400}y$ b", "formula"), (f"a $1{'+x' * 500}=y$ b", "formula")):
        store = markup._Store()
        markup._set_formulas_aside(text, store)
        assert [k for k, _ in store.parts] == [kind] and store.langs == {"latex"}
    store = markup._Store()
    assert markup._set_formulas_aside("$$ $$ prose $$x^2$$ end", store).startswith("$$ $$ prose ") and store.parts == [("display", "x^2")]
    assert markup._set_formulas_aside("$1" + "=" * 50_000, markup._Store()) == "$1" + "=" * 50_000


def test_lists_of_links_stay():
    page = "<body>\n<p>" + "A long paragraph of words. " * 30 + "</p>\n" + "\n".join(f"<ul><li><a href='http://x.y/{k}'>Link {k}</a></li></ul>" for k in range(8)) + "\n<p>" + "More words here. " * 30 + "</p>\n</body>"
    text, langs = markup.clean(page)
    assert langs == ["html"] and all(f"- Link {k}" in text for k in range(8))


def test_every_pattern_holds_its_hint():
    """A mark is found with its hint and not without: each sample holds just one."""
    for sample in ("# H", "T\n===", "T\n---", "a **b** c", "a __b__ c", "a ~~b~~ c", "a *b* c", "a _b_ c", "[a](b)", "[a][b]", "[a] [b]", "[a]: b", "x[^1]", "> q", "- [x] t", "a | b\n--|--\nc | d"):
        assert markup.clean(sample)[1] == ["markdown"], sample
    for sample in ("[[a]]", "{{a}}", "== a ==", "''a''", "'''a'''", "{|\n", "x\n|}", "[http://a.b c]", "#redirect [[x]]", "__TOC__"):
        assert markup.clean(sample)[1] == ["wiki"], sample
