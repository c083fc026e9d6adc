import pytest

from tidegrid.llm.html_extract import blocks_of


def text(source):
    return "\n".join(b.text for b in blocks_of(source))


@pytest.mark.parametrize(
    "part",
    ['<svg width="1"/>', "<svg/>", "<svg-icon></svg-icon>", "<select-box></select-box>", "<object-x></object-x>", "<script-x></script-x>", "<select><option>a", "<svg><path d='M0'>", "<object data='x'>", "<template>", "<noscript>", "<math>"],
)
def test_what_follows_is_kept(part):
    source = f"<p>before</p>{part}<p>after one</p><p>after two</p>"
    assert text(source).startswith("before") and text(source).endswith("after one\nafter two")


def test_unclosed_does_not_reach_a_later_one():
    assert "between" in text("<select><p>between</p><select><option>x</option></select><p>end</p>")


def test_formula_and_fallback_are_text():
    assert text("<p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be <svg><path/></svg>so</p>") == "let x=2 be so"
    assert text("<p>see <object data='a.pdf'>the <b>paper</b></object> now</p>") == "see the paper now"


def test_skipped_elements_stay_skipped():
    source = "<p>a</p><SELECT name=x><option>no</option></SELECT><template><p>no</p></template><noscript>no</noscript><iframe src=x>no</iframe><textarea>no</textarea><script>no</script ><p>b</p><script>no"
    assert text(source) == "a\nb"


@pytest.mark.parametrize(
    "source,want",
    [
        ('<p title="x>y</p><p>z</p>', "y\nz"),
        ("<p>a</p><p title='x>b</p><p>it is</p>", "a\nb\nit is"),
        ('<p>a</p><p title="1 > 0" class=\'q">\'>b</p>', "a\nb"),
        ("<title-bar>x</title-bar><p>y</p>", "x\ny"),
        ("<math-field>x</math-field><p>y</p>", "x\ny"),
        ("<p>a < b and <3</p>", "a < b and <3"),
        ("<p>one<p>two</div></b><i>three</p>four", "one\ntwo\nthree\nfour"),
        ("<p>end <a href='x", "end"),
        ("", ""),
    ],
)
def test_hostile_pages(source, want):
    assert text(source) == want


@pytest.mark.parametrize("part", ["<div>t", "<b>t", "</i>", "<p>a</b>", "<a 'x", "<div><b>t</div>"])
def test_deep_nesting_takes_linear_time_and_memory(part):
    import time

    from tidegrid.llm.html_extract import vectors

    began = time.process_time()
    blocks = blocks_of("<p>first</p>" + part * 200_000)
    assert blocks[0].text == "first" and time.process_time() - began < 15
    assert len(vectors(blocks[-100:])) == min(100, len(blocks))
