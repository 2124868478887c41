"""Training pages for the block labeller: random sites with known main text.

No labelled pages are bundled, so pages are made up: the order of the parts,
the elements, the class names and the wording vary; which blocks are the
article's is known.  The words are random syllables, so that the labeller
learns from structure, from the cue words below and from the neighbourhood.
"""

from __future__ import annotations

import random

# Names that sites give to their parts, and words found in them.
MAIN_NAMES = "article content post entry story main body text page-content post-body entry-content article-body main-content story-body blog-post".split()
OUTER_NAMES = "wrapper container page site layout row col inner root app".split()
NAMES = {
    "menu": "nav menu navbar navigation main-nav topnav breadcrumb breadcrumbs tabs nav-links site-nav".split(),
    "header": "header site-header masthead top banner branding page-header topbar".split(),
    "footer": "footer site-footer bottom copyright legal page-footer credits colophon".split(),
    "sidebar": "sidebar aside widget widgets related recommended popular side-column rail secondary tags".split(),
    "notice": "notice cookie cookie-banner consent alert gdpr popup modal cookie-notice privacy-notice overlay message".split(),
    "ad": "ad ads advert advertisement sponsored promo banner-ad adsbox ad-slot sponsor promotion".split(),
    "form": "newsletter subscribe signup search login contact-form search-form form subscription".split(),
    "comments": "comments comment comment-list reply replies discussion comment-body disqus respond user-comments".split(),
    "share": "share social sharing share-buttons follow social-links".split(),
}
CUES = {
    "menu": "Home About Contact News Products Blog Archive Sports Help Login Services".split(),
    "header": "Welcome to the official site Your daily source since".split(),
    "footer": "© Copyright All rights reserved Terms Privacy Policy Imprint Powered by".split(),
    "sidebar": "Related articles Popular posts Most read Recent Tags Categories Archives You may also like".split(),
    "notice": "We use cookies to improve your experience Accept consent privacy settings".split(),
    "ad": "Sponsored Advertisement Buy now Sale offer discount free shipping deal".split(),
    "form": "Subscribe to our newsletter Enter your email Search Submit Name Password Sign up".split(),
    "comments": "Reply Comment says wrote Comments Leave a comment posted ago".split(),
    "share": "Share Tweet Facebook Follow us Like Email Print".split(),
}
ELEMENTS = {
    "menu": ("nav", "ul", "div"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div", "section"), "notice": ("div", "section", "dialog"),
    "ad": ("div", "aside", "ins-box", "section"), "form": ("form", "div"), "comments": ("section", "div", "ol"), "share": ("div", "ul"),
}
SYLLABLES = "an be ch da en er fo ge ha in is ka le lo mi na ne on or pe ra re sa se st ta te th ti un ve wa".split()


class Site:
    """One random page and the texts of its main blocks."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.main: set[str] = set()
        plain = rng.random() < 0.35  # elements say what a part is, or names do, or both
        self.semantic = plain or rng.random() < 0.5
        self.named = not plain or rng.random() < 0.3
        before, after = [], []
        for kind, chance, early in (
            ("notice", 0.3, 0.7), ("header", 0.6, 1.0), ("menu", 0.8, 0.9), ("ad", 0.5, 0.6), ("form", 0.3, 0.5), ("share", 0.25, 0.3),
            ("sidebar", 0.5, 0.3), ("comments", 0.4, 0.0), ("footer", 0.8, 0.0),
        ):
            for _ in range(rng.choice((1, 1, 2))):
                if rng.random() < chance:
                    (before if rng.random() < early else after).append(self.part(kind))
        rng.shuffle(before)
        body = "".join(before) + self.article() + "".join(after)
        for _ in range(rng.randrange(3)):
            body = f"<div {self.name(OUTER_NAMES)}>{body}</div>"
        self.html = f"<!DOCTYPE html><html><head><title>{self.sentence()}</title></head><body>{body}</body></html>"

    def word(self) -> str:
        return "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def sentence(self) -> str:
        words = [self.word() for _ in range(self.rng.randint(1, 16))]
        if self.rng.random() < 0.3:
            words[len(words) // 2] += ","
        return " ".join(words).capitalize() + self.rng.choice("....!?")

    def prose(self, longest: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(1, longest)))

    def name(self, names: list[str]) -> str:
        return f'{self.rng.choice(("class", "class", "id"))}="{self.rng.choice(names)}"'

    def part(self, kind: str) -> str:
        rng = self.rng
        tag = ELEMENTS[kind][0] if self.semantic else rng.choice(ELEMENTS[kind])
        shown = self.named or tag in ("div", "section", "ul", "ol", "ins-box")
        attrs = " " + self.name(NAMES[kind]) if shown and (tag != "div" or rng.random() < 0.97) else ""
        cue = lambda k: " ".join(rng.choice(CUES[kind]) for _ in range(rng.randint(1, k)))
        label = lambda: rng.choice((cue(3), self.word().capitalize(), self.word()))
        if kind in ("menu", "share") or kind == "sidebar" and rng.random() < 0.6:
            items = "".join(f'<li><a href="/{self.word()}">{label()}</a></li>' for _ in range(rng.randint(2, 9)))
            inner = items if tag in ("ul", "ol") else f"<ul>{items}</ul>"
            if kind == "sidebar":
                inner = f"<h3>{cue(3)}</h3>{inner}"
        elif kind == "comments":
            inner = f"<h3>{cue(2)}</h3>" * (rng.random() < 0.6)
            for _ in range(rng.randint(1, 5)):
                who = f"<span>{self.word()} {cue(2)}</span>" * (rng.random() < 0.6)
                inner += f"<div {self.name(NAMES[kind])}>{who}<p>{self.prose(3)}</p></div>" if rng.random() < 0.7 else f"<p>{self.prose(3)}</p>"
        elif kind == "form":
            inner = f"<label>{cue(4)}</label><input name=q>" + rng.choice(("", f"<p>{cue(5)} {self.word()}.</p>")) + f"<button>{cue(2)}</button>"
        elif kind == "footer":
            inner = rng.choice((f"&copy; {self.word()}.example &middot; {self.prose(1)}", f"<p>{cue(5)}</p>", f"<p>{self.prose(2)}</p><a href=/t>{cue(2)}</a>", f"{cue(4)} {self.word()}"))
        else:
            inner = rng.choice((self.prose(3), f"<p>{self.prose(2)}</p>", f"{cue(5)} {self.prose(1)}", f'<a href="/x">{cue(3)}</a>', f"<p>{cue(6)}</p>"))
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def keep(self, text: str) -> str:
        self.main.add(text)
        return text

    def article(self) -> str:
        rng = self.rng
        inner = f"<h1>{self.keep(self.sentence())}</h1>" if rng.random() < 0.8 else ""
        for i in range(rng.choice((1, 2, 4, 8, 12, 20, 30))):
            if i and rng.random() < 0.06:
                inner += self.part(rng.choice(("ad", "share", "form", "sidebar", "notice")))
            kind = rng.random()
            text = self.keep(self.prose(8) if rng.random() < 0.75 else self.sentence() if rng.random() < 0.7 else f"{self.word()}.".capitalize())
            if rng.random() < 0.12:  # an article may use any words
                text = self.keep(" ".join(rng.choice(rng.choice(list(CUES.values()))) for _ in range(rng.randint(2, 6))) + ".")
            first, _, rest = text.partition(" ")
            if kind < 0.7:
                inner += rng.choice((f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f'<p><a href="/y">{first}</a> {rest}</p>'))
            elif kind < 0.8:
                inner += f"<h{(n := rng.choice('23'))}>{text}</h{n}>"
            elif kind < 0.9:
                inner += "<ul>" + "".join(f"<li>{self.keep(self.prose(2))}</li>" for _ in range(rng.randint(1, 5))) + f"</ul><p>{text}</p>"
            else:
                inner += f"<blockquote><p>{text}</p></blockquote>"
        style = rng.random()
        if self.semantic and style < 0.75:
            attrs = " " + self.name(MAIN_NAMES) if rng.random() < 0.3 else ""
            tag = rng.choice(("article", "article", "main"))
            return f"<{tag}{attrs}>{inner}</{tag}>"
        if style < 0.93:
            return f"<div {self.name(MAIN_NAMES)}>{inner}</div>"
        return inner


def training_pages(n: int, seed: int) -> list[Site]:
    rng = random.Random(seed)
    return [Site(rng) for _ in range(n)]
