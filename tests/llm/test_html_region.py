import pytest

from kindred.llm import html_text

PAGE = '<html><body><nav><ul><li><a href="/">Home page</a></li></ul></nav>{}<footer>Owner of the site</footer></body></html>'
LEAD, BODY = ("Lead words come first here. " * 20).strip(), ("Body words come after them. " * 30).strip()


@pytest.mark.parametrize("body, want", [
    (f"<article><h1>Part one</h1><p>{LEAD}</p></article><article><p>{BODY}</p><p>End.</p></article>", f"Part one\n\n{LEAD}\n\n{BODY}\n\nEnd."),
    (f"<main><h1>Head</h1><p>{LEAD}</p><article><p>{BODY}</p></article><p>End.</p></main>", f"Head\n\n{LEAD}\n\n{BODY}\n\nEnd."),
    (f"<h1>Head</h1><p>{LEAD}</p><article><p>{BODY}</p><nav><a>Inner menu</a></nav><p>One.</p><p>End.</p></article>", f"Head\n\n{LEAD}\n\n{BODY}\n\nOne.\n\nEnd."),
])
def test_text_across_holders_is_whole(body, want):
    assert html_text.main_text(PAGE.format(body)) == want
