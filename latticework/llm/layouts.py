"""Pages of many layouts with known main text, from a seed: what the costs of page extraction are fitted on.

A third says what is what by its elements, a third by names of classes only, a third says nothing. Words are invented.
"""

from __future__ import annotations

import random

PARTS = "b c d f g h k l m n p r s t v w st tr pl gr".split()
ENDS = "a e i o u an el ir os um".split()
WRAPPED = "sidebar comments footer top share menu social header promo widgets".split()
STYLES = ("elements", "classes", "bare")


class Page:
    def __init__(self, seed: int, style: str | None = None) -> None:
        self.rng = random.Random(seed)
        self.style = style or STYLES[seed % 3]
        self.main: list[str] = []
        self.vocabulary = [self.word() for _ in range(400)]

    def word(self) -> str:
        return "".join(self.rng.choice(PARTS) + self.rng.choice(ENDS) for _ in range(self.rng.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.rng.choice(self.vocabulary) for _ in range(self.rng.randint(low, high)))

    def prose(self, sentences: int) -> str:
        out = []
        for _ in range(sentences):
            s = self.words(4, 18)
            if self.rng.random() < 0.4:
                s = s.replace(" ", ", ", 1)
            out.append(s[0].upper() + s[1:] + self.rng.choice("...?!"))
        return " ".join(out)

    def element(self, tag: str, name: str, inside: str) -> str:
        """An element that says what it is as far as the style allows."""
        if self.style == "elements":
            return f"<{tag}>{inside}</{tag}>" if tag != "div" else f'<div class="{name}">{inside}</div>'
        if self.style == "classes":
            return f'<div class="{name}">{inside}</div>'
        return f'<div class="x{self.rng.randint(10, 99)}">{inside}</div>'

    def links(self, n: int, low: int = 1, high: int = 3) -> str:
        item = lambda: f'<li><a href="/{self.word()}">{self.words(low, high)}</a></li>'
        return "<ul>" + "".join(item() for _ in range(n)) + "</ul>"

    def told(self, text: str, tag: str) -> str:
        self.main.append(text)
        shown = text
        if self.rng.random() < 0.25:
            first, _, rest = text.partition(" ")
            shown = f"<a href='/{first}'>{first}</a> {rest}" if rest else text
        return f"<{tag}>{shown}</{tag}>"

    def article(self) -> str:
        r = self.rng
        out = [self.told(self.words(3, 9).capitalize(), "h1")] if r.random() < 0.8 else [self.told(self.prose(1), "p")]
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.55:
                out.append(self.told(self.prose(r.randint(1, 6)), "p"))
            elif kind < 0.7:
                out.append(self.told(self.words(1, 4).capitalize() + ".", "p"))
            elif kind < 0.75:
                out.append(self.told(self.words(1, 4), "p"))
            elif kind < 0.8:
                out.append(self.told(self.words(2, 5).capitalize(), "h2"))
            elif kind < 0.9:
                out.append("<ul>" + "".join(self.told(self.words(1, 9), "li") for _ in range(r.randint(2, 5))) + "</ul>")
            else:
                out.append("<blockquote>" + self.told(self.prose(1), "p") + "</blockquote>")
            if r.random() < 0.12 and self.style != "bare":
                inside = self.prose(r.randint(1, 6)) if r.random() < 0.5 else self.words(2, 6)
                out.append(self.element("aside", "advert", f"<p>{inside}</p>") if r.random() < 0.5 else f'<p class="promo">{inside}</p>')
        if self.style != "bare" and r.random() < 0.2:
            out.append(self.comments())
        return "".join(out)

    def comments(self) -> str:
        one = lambda: f'<div><p><a href="/u">{self.word()}</a> {self.rng.randint(1, 9)} <a href="/r">{self.word()}</a></p><p>{self.prose(self.rng.randint(1, 9))}</p></div>'
        return self.element("div", "comments", "".join(one() for _ in range(self.rng.randint(1, 4))))

    def html(self) -> str:
        r, body = self.rng, []
        if r.random() < 0.1:  # a page that is nothing but a text
            self.main = [self.words(2, 12)]
            return self.main[0]
        if r.random() < 0.75:
            body.append(self.element("header", "header", f"<div><a href='/'>{self.words(1, 3)}</a></div>" + self.element("nav", "nav", self.links(r.randint(3, 9)))))
        if r.random() < (0.05 if self.style == "bare" else 0.4):  # prose that nothing tells from the article's
            body.append(self.element("div", "cookie-notice", f"<p>{self.prose(r.randint(1, 3))}</p><button>{self.word()}</button>"))
        if r.random() < 0.4:
            body.append(self.element("div", "ad", self.words(2, 6)))
        if self.style == "elements" and r.random() < 0.4:
            body.append(f'<div class="x{r.randint(10, 99)}"><p>{self.prose(r.randint(1, 6))}</p></div>')  # nothing but its place tells
        side = self.element("aside", "sidebar", f"<h3>{self.words(1, 2)}</h3>" + self.links(r.randint(3, 8), 2, 7)) if r.random() < 0.6 else ""
        article = self.element("article", "article", self.article())
        body += [side, article] if r.random() < 0.4 else [article, side]
        if r.random() < 0.4:
            body.append(self.comments() if self.style != "bare" else "")
        if r.random() < 0.4:
            body.append(self.element("form", "newsletter", f"<label>{self.words(1, 4)}</label><input><button>{self.word()}</button>"))
        if r.random() < 0.8:
            body.append(self.element("footer", "footer", f"<p>&copy; {self.words(1, 3)}{' ' + self.prose(2) if r.random() < 0.3 else ''}</p>" + self.links(r.randint(2, 6))))
        inside = "".join(body)
        if r.random() < 0.3:  # names of what the page has or is, round all of it
            told = r.choice(("has", "no", "with", "page", "site", "x")) + "-" + r.choice(WRAPPED)
            inside = r.choice((f'<div class="layout {told}">{inside}</div>', f'<div id="{told}">{inside}</div>', f'<form id="{told}">{inside}</form>', f'<div id="{r.choice(WRAPPED)}">{inside}</div>'))
        return f"<!DOCTYPE html><html><head><title>{self.main[0]}</title><script>var a = '<p>';</script></head><body>{inside}</body></html>"


def page(seed: int, style: str | None = None) -> tuple[str, list[str]]:
    """html, and the blocks of its main text in order."""
    p = Page(seed, style)
    html = p.html()
    return html, p.main
