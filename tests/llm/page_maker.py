"""Made web pages whose main text is known."""

import random

WORDS = "an be cat do er fin go hat is jet kin low man nor old pet qi red sun tan up van wet yes zip bright corner window river table answer morning little people water another".split()


def make(seed: int) -> tuple[str, list[str]]:
    """(html, the blocks of its main text), the same for each seed. The main text is marked by an element, by a class or by nothing; so are the other parts, except that unmarked ones hold links or short scraps."""
    r = random.Random(seed)
    words = lambda a, b: " ".join(r.choice(WORDS) for _ in range(r.randint(a, b)))
    sentence = lambda: words(6, 18).capitalize() + r.choice("...!?")
    link = lambda a, b: f'<a href="/{r.randrange(99)}">{words(a, b)}</a>'
    main: list[str] = []
    body: list[str] = []

    def content(text: str, html: str) -> None:
        main.append(text)
        body.append(html)

    title = words(3, 9).capitalize()
    above = r.random() < 0.2
    content(title, "" if above else f"<h1>{title}</h1>")
    for _ in range(r.randint(2, 9)):
        kind = r.randrange(10)
        if kind < 5:
            t = " ".join(sentence() for _ in range(r.randint(1, 6)))
            content(t, f"<p>{t}</p>")
        elif kind == 5:
            a, b = sentence(), words(1, 3)
            content(f"{a} {b} &" , f'<p>{a} <a href="x">{b}</a> &amp;</p>')
        elif kind == 6:
            t = words(2, 6)
            content(t, f"<h2 id='share-price'>{t}</h2>")
        elif kind == 7:
            items = [words(2, 9) + r.choice([".", ""]) for _ in range(r.randint(2, 5))]
            body.append("<ul>")
            for t in items:
                content(t, f"<li>{t}</li>")
            body.append("</ul>")
        elif kind == 8:
            a, b = words(3, 6).capitalize(), words(2, 5)
            content(f"{a} x=2 {b}.", f"<p>{a} <math>x=2</math> <button>{b}</button>.</p>")
        else:
            t = sentence()
            content(t, f"<blockquote><p class='share-price'>{t}</p></blockquote>")
        if r.random() < 0.15:
            body.append(r.choice([f'<div class="advert">{sentence()}</div>', f'<div class="share-buttons">{link(1, 2)} {link(1, 2)}</div>', f"<form><label>{words(1, 3)}</label><button>{words(1, 2)}</button></form>", f"<aside><p>{sentence()}</p></aside>", f"<div><button>{words(1, 4)}</button></div>"]))
    text = "".join(body)
    wrap = r.randrange(4)
    marked = (f"<article>{text}</article>", f"<main>{text}</main>", f'<div class="post-content">{text}</div>', f"<div>{text}</div>")[wrap]
    if above:
        marked = f"<h1>{title}</h1>{marked}"
    if wrap < 3 and r.random() < 0.3:  # text beside a marked article
        stray = [f"<div>{sentence()}</div>", f"<p>{sentence()} {sentence()}</p>", f"<h2>{words(1, 4)}</h2>"]
        marked = r.choice(stray) + marked if r.random() < 0.5 else marked + r.choice(stray)
    menu = "".join(f"<li>{link(1, 3)}</li>" for _ in range(r.randint(3, 9)))
    top = r.choice([f"<nav><ul>{menu}</ul></nav>", f"<header>{link(1, 2)}<ul>{menu}</ul></header>", f'<div id="mainNav"><ul>{menu}</ul></div>', f"<ul>{menu}</ul>"])
    notice = r.choice(["", f'<div class="cookie-notice">{sentence()} <button>{words(1, 2)}</button></div>', f'<div role="dialog" class="popup">{sentence()}</div>'])
    related = "".join(f"<li>{link(3, 8)}</li>" for _ in range(r.randint(2, 6)))
    side = r.choice(["", f'<aside><h3>{words(1, 3)}</h3><p>{sentence()}</p></aside>', f'<div class="sidebar-left"><p>{sentence()}</p></div>', f"<ul>{related}</ul>"])
    said = "".join(f"<div><b>{words(1, 1)}</b><p>{sentence()}</p></div>" for _ in range(r.randint(1, 4)))
    comments = r.choice(["", f'<section class="comments"><h3>{words(1, 2)}</h3>{said}</section>', f'<div id="comments-area">{said}</div>'])
    foot = r.choice([f"<footer>&copy; {words(1, 4)}</footer>", f'<div class="site-footer">{link(1, 3)} {link(1, 3)} {words(2, 5)}</div>', f"<div>&copy; {words(1, 3)} {link(1, 2)} {link(1, 2)}</div>"])
    page = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{top}{notice}<script>var t='<p>';</script>{marked}{side}{comments}{foot}</body></html>"
    return page, main
