"""Text quality statistics, and a verdict whether a text is natural prose, by a Gaussian mixture over its lines."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecquarry.operators.sums import tree_sum
from vecquarry.session import materialize

#: Frequent words of languages that the table of common words may lack, and frequent Chinese characters.
MORE_WORDS = """
il lo la gli le di del della dei in nel con per che non si è sono una un come più anche questo ha ma tra quando molto
alla dal ai da se ci chi cui loro suo sua era stato essere fa ogni prima dopo poi quasi stesso ancora perché dove
ja on ei se että joka mutta kun myös oli tai jos niin ovat vielä sen miksi minkä emme noin tämä siitä eikä enää koko
hän minä sinä me te he ne nämä mikä mitä mistä missä miten kuka jotka jossa josta jota kuin vain nyt sitten siellä jo
kaikki toinen ole olen olemme ollut olisi voi sekä sillä koska vaikka kuitenkin aina usein hyvin paljon vähän enemmän
hieman juuri kerran ainakin luultavasti ehkä jälkeen ennen kanssa ilman yli alle mukaan joten meille heille oma
de het een en van dat niet is op te zijn met voor maar ook o a os as um uma e do da em não que com para por mais
och att det som en på är av för inte den med har till ett om vi men så
的 一 是 不 了 在 人 有 我 他 这 为 之 大 来 以 个 中 上 们 到 说 和 地 也 时 道 出 而 要 于 就 下 得 可 你 年 自 会 那 后 能 对
着 事 其 里 所 去 行 过 用 如 然 作 方 成 者 多 都 没 同 么 当 起 与 好 看 还 分 此 前 面 又 定 见 只 从 很 先 给 但 因 果 想 让
"""

#: Inspected examples of each form. The components of the mixture begin at them and are named after them.
EXAMPLES = [
    ("prose", "english", "My grandmother kept bees behind the old mill, and every autumn she gave a jar of honey to each of her neighbours."),
    ("prose", "english", "Nobody had expected the bridge to close, so the whole village went the long way round until it was mended."),
    ("prose", "english", "Could you tell me when the next ferry leaves? I would rather not stay here for another night if it can be helped."),
    ("prose", "english", "she said that it would rain before the evening but we went out anyway and none of us took a coat"),
    ("prose", "english", "It was not the cold that troubled them most, but the noise which came from the harbour at all hours."),
    ("prose", "english", "THE DOOR WAS LOCKED WHEN WE CAME BACK, AND THE ONLY KEY WAS STILL ON THE TABLE IN THE KITCHEN."),
    ("prose", "english with numbers", "Of the 214 passengers who left in May, only 37 had come home by the end of 1921, and most of these were ill."),
    ("prose", "english with numbers", "The soup needs 25 minutes at 90 degrees; after that, add about 3.5 g of salt and leave it for an hour."),
    ("prose", "english with numbers", "Rents went up by 6.2 % in the first year but by just 1.9 % in the second, which surprised even the landlords."),
    ("prose", "english with numbers", "Chapter 12 (see page 340) says that the tower was 61 m high before the fire of 1703."),
    ("prose", "european", "Meine Schwester wohnt seit dem Frühling in einem kleinen Haus am See, aber sie ist nur selten dort."),
    ("prose", "european", "Le boulanger ouvre sa porte avant le lever du jour, et les enfants du quartier viennent pour le pain chaud."),
    ("prose", "european", "Cuando llegamos a la estación ya no quedaba nadie, así que tuvimos que volver a casa por el camino del río."),
    ("prose", "european", "Il treno era in ritardo e noi non avevamo più niente da mangiare, ma una signora ci ha dato del pane."),
    ("prose", "european", "Ela não sabia que o irmão tinha voltado para a aldeia e que a casa já não era de ninguém."),
    ("prose", "european with numbers", "Im Jahr 1848 hatte die Stadt 5.200 Einwohner, und nur 12 % von ihnen durften bei der Wahl eine Stimme abgeben."),
    ("prose", "european with numbers", "Il faut 250 g de farine et 3 œufs, puis on laisse la pâte au froid pendant 45 minutes avant de la cuire."),
    ("prose", "european with numbers", "El autobús número 27 sale cada 15 minutos, pero los domingos hay que esperar hasta 40 en la parada."),
    ("prose", "european with numbers", "Nel 1966 l'acqua è salita di 4.92 m in una notte, e per 6 giorni non si è potuto entrare nelle case."),
    ("prose", "finnish", "Isoisä kertoi meille usein sodasta, mutta hän ei koskaan puhunut siitä, mitä oli tapahtunut hänen veljelleen."),
    ("prose", "finnish", "Vanha silta suljettiin keväällä, joten kylän lapset kulkevat nyt kouluun metsän läpi."),
    ("prose", "finnish", "Järvellä oli 14 venettä, ja niistä 3 oli niin huonossa kunnossa, että niitä ei enää korjattu."),
    ("prose", "finnish", "Naapuri osti uuden auton, vaikka vanha olisi vielä kestänyt monta vuotta."),
    ("prose", "finnish", "lääkäri sanoi ettei polvea tarvitse leikata jos sitä lepuuttaa tarpeeksi kauan"),
    ("prose", "finnish", "Saunan ovi jäi auki, ja puolet lämmöstä karkasi pihalle ennen kuin huomasimme sen."),
    ("prose", "finnish", "Vuonna 1952 tehtaassa oli töissä 340 ihmistä, mutta heistä vain 28 sai jäädä, kun se myytiin."),
    ("prose", "chinese", "昨天晚上下了很大的雨，所以我们没有去公园，而是在家里看了一部老电影。"),
    ("prose", "chinese", "他在这家工厂工作了32年，去年冬天才退休，现在每天早上六点去河边散步。"),
    ("prose", "chinese", "请问去火车站怎么走？从这里一直往前，过了第二个路口就到了。"),
    ("prose", "chinese", "如果明天下雨，我们就不去爬山了。"),
    ("prose", "chinese", "我觉得这件衣服太贵了，你能不能便宜一点？"),
    ("prose", "chinese", "老师说，只要每天练习，就一定会有进步。"),
    ("list", "salad", "kettle pigeon velvet ladder thunder basket hammock pepper chimney walrus button meadow"),
    ("list", "salad", "Pigeon. Velvet ladder. Thunder basket hammock, pepper. Chimney walrus button. Meadow kettle."),
    ("list", "salad", "Teppich Apfel Gewitter Leiter Knopf Wiese Kessel Taube Schornstein Hammer Schrank Wolke"),
    ("list", "salad", "tapis pomme orage échelle bouton prairie bouilloire pigeon cheminée marteau armoire nuage"),
    ("list", "salad", "alfombra manzana tormenta escalera botón prado tetera paloma chimenea martillo armario nube"),
    ("list", "long salad", "kettle pigeon kettle ladder thunder pigeon hammock kettle pepper ladder pigeon walrus kettle button meadow hammock pigeon thunder kettle pepper ladder walrus"),
    ("list", "long salad", "Teppich Apfel Teppich Leiter Knopf Apfel Kessel Teppich Taube Leiter Apfel Hammer Teppich Wolke Knopf Apfel Kessel Leiter"),
    ("list", "tasks", "Buy candles"),
    ("list", "tasks", "3. Water the tomatoes"),
    ("list", "tasks", "- [x] Renew passport"),
    ("list", "tasks", "* wool socks (two pairs)"),
    ("list", "commas", "kettle, pigeon, velvet, ladder, thunder, basket, hammock, pepper, chimney, walrus"),
    ("list", "commas", "Teppich; Apfel; Gewitter; Leiter; Knopf; Wiese; Kessel; Taube; Hammer"),
    ("list", "chinese salad", "地毯 苹果 雷雨 梯子 纽扣 草地 水壶 鸽子 烟囱 锤子 柜子 云"),
    ("list", "chinese salad", "苹果、梯子、水壶、鸽子、锤子、云、草地、纽扣"),
    ("list", "menu", "Start | Fixtures | Tickets | Museum | Fan shop | Directions | Login"),
    ("list", "menu", "Home > Garden > Furniture > Benches > Oak"),
    ("list", "menu", "Contact us / How to find us / Back to the shop / What we do / See the whole range / Help"),
    ("list", "menu", "Roast lamb ........ 18.50"),
    ("list", "menu", "Chapter 4 -> 87"),
    ("list", "settings", "max_upload_size: 64"),
    ("list", "settings", "cache.enabled = true"),
    ("list", "settings", "\"timeout_ms\": 3000,"),
    ("list", "settings", "retries=5"),
    ("table", "numbers", "| Oslo | 12.4 | 1013 | 0.82 | 44 |"),
    ("table", "numbers", "1987,14.2,0.551,88,1203.7,0.03"),
    ("table", "numbers", "Bergen      3.91     0.117     22810     0.4401"),
    ("table", "numbers", "Turku & 0.731 & 15.2 & 408 \\\\"),
    ("table", "words", "| name | street | town | country | remarks |"),
    ("table", "words", "|------|:------:|------|--------:|"),
    ("junk", "code", "while (p != NULL && p->next) { total += p->count * 2; p = p->next; }"),
    ("junk", "code", "return {k: v.strip() for k, v in row.items() if k not in skip}"),
    ("junk", "code", "const items = (await fetchAll(url)).map(x => x.id);"),
    ("junk", "log", "Feb 11 03:22:10 mailhost postfix/smtpd[2217]: connect from unknown[10.3.0.7]"),
    ("junk", "log", "[INFO ] 12:41:09.233 http-nio-80 GET /api/v2/orders/8812 200 35ms"),
    ("junk", "trace", "  File \"/srv/app/views.py\", line 88, in get_queryset"),
    ("junk", "trace", "    at org.shop.Cart.addItem(Cart.java:142)"),
    ("junk", "trace", "    at Object.render (app.js:118:9)"),
    ("junk", "trace", "             at src/main.rs:42:17"),
    ("junk", "encoded", "TWFueSBoYW5kcyBtYWtlIGxpZ2h0IHdvcms/Zm9vYmFyQmF6MTIzNDU2Nzg5MGFiY2RlZmdoaWprbG1ub3Bx"),
    ("junk", "encoded", "d41d8cd98f00b204e9800998ecf8427e 7215ee9c7d9dc229d2921a40e899ec5f"),
    ("junk", "garbled", "#%}{~^|@ ?=*&]/[ ;$!<>+ ^^%#{]|~ @*&=!? }{$;:/ ~#%^"),
    ("junk", "garbled", "Ã¤hnlich wÃ¼rde fÃ¼r â€ž GrÃ¶ÃŸe â€œ gelÃ¶st â‚¬ Ã‰cole dÃ©jÃ\xa0 vÃ©cu"),
]
STATISTICS = ["common", "length", "symbols", "digits", "separators", "longest", "repeated", "turns", "spread"]
COUNTS = ["chars", "words", "word_chars", "common_words", "symbol_chars", "ends"]
#: Added to the variances of the components, in units of the whole variance.
RIDGE = 0.05
#: In every step the examples together count as this share of all lines, and as one line each at least, each in its own component, which keeps
#: components from trading places.
ANCHOR = 0.05
#: Variance at which components begin, and the number of lines for which it goes on counting: what explains few lines stays wide.
START, PRIOR_LINES = 0.3, 10
#: Steps end when the mean logarithm of the lines' densities grows by less than this, or, at the latest, after MOST_STEPS.
GAIN, MOST_STEPS = 2e-3, 60
#: Most common words that are held in every task.
MOST_WORDS = 1_000_000
#: Characters that are worked on at once, unless a line is longer.
PIECE = 1 << 20

TAG, ADDRESS = re.compile(r"<[a-zA-Z/!][^<>]*>"), re.compile(r"https?://[^\s，。]+")
#: Characters of Han script and those taken off (invisible ones, emoji and signs), as ranges.
HAN = [(0x3005, 0x3005), (0x3007, 0x3007), (0x3021, 0x3029), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)]
HIDDEN = [(0x00AD, 0x00AD), (0x200B, 0x200F), (0x2060, 0x2060), (0x2600, 0x27BF), (0xFE0E, 0xFE0F), (0xFEFF, 0xFEFF), (0x1F000, 0x1FAFF)]
#: Marks that are no symbols, marks that separate, that end words for the longest run, that end lines, sentences,
#: and quotations, and that join letters in code and names.
PLAIN_MARKS = ".,;:!?'\"()-…‐‑‒–—―‘’‚‛“”„‟«»¿¡、。，！？：；（）「」『』《》"
SEPARATORS, CUTS, LINE_ENDS, ENDS, CLOSERS, JOINERS = ",;:|\t=&/_<>→»•·、；：", "-/,.…，。", "\n\r\x0b\x0c\x85\u2028\u2029", ".!?…。！？:;", "\"'”’)»」", "!#$%&()*+,./:;<=>?@[\\]^_`{|}~"
BIT = {name: 1 << i for i, name in enumerate(["letter", "number", "han", "space", "line", "plain", "separator", "cut", "lower", "upper", "end", "closer", "joiner"])}
CODES = 0x32400


@functools.lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: its classes (bits), the letter it folds to (lower case without accents; 0 for none), if it is hidden."""
    bits, fold, hidden = np.zeros(CODES, np.uint16), np.zeros(CODES, np.uint32), np.zeros(CODES, bool)
    for a, b in HAN:
        bits[a : b + 1] |= BIT["han"]
    for a, b in HIDDEN:
        hidden[a : b + 1] = True
    for code in range(CODES):
        c, kind = chr(code), unicodedata.category(chr(code))
        if kind[0] in "LM":
            bits[code] |= BIT["letter"] | BIT["plain"]
            if kind[0] == "L":
                fold[code] = ord(unicodedata.normalize("NFD", c)[0].lower()[0])
        elif kind[0] == "N":
            bits[code] |= BIT["number"] | BIT["plain"]
        if c.isspace():
            bits[code] |= BIT["space"] | BIT["cut"]
        if kind in ("Ll", "Lu"):
            bits[code] |= BIT["lower"] if kind == "Ll" else BIT["upper"]
    for name, marks in (("plain", PLAIN_MARKS), ("separator", SEPARATORS), ("cut", CUTS), ("line", LINE_ENDS), ("end", ENDS), ("closer", CLOSERS), ("joiner", JOINERS)):
        bits[[ord(c) for c in marks]] |= BIT[name]
    bits[[ord(c) for c in LINE_ENDS]] |= BIT["space"] | BIT["cut"]
    return bits, fold, hidden


@functools.lru_cache(1)
def _powers() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _word_hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of 64 bits of folded[start:end] of each word; of a 65th letter on only the sum of the letters counts."""
    place = np.arange(len(folded)) - np.repeat(starts, ends - starts)
    spread = (folded.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(29)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread * _powers()[np.minimum(place, 63)], dtype=np.uint64)])
    return upto[ends] - upto[starts] ^ (ends - starts).astype(np.uint64)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _words(codes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, letters, hash) of every word: runs of letters and marks, and single Han characters. Marks are not counted."""
    folded = tables()[1][codes]
    letter, han = (bits & BIT["letter"]) > 0, (bits & BIT["han"]) > 0
    word = letter & ~han
    first = (word & ~np.concatenate([[False], word[:-1]])) | (han & letter)
    kept = letter & (folded > 0)
    owner = (np.cumsum(first) - 1)[kept]  # the word of each kept letter
    at = np.flatnonzero(first)
    ends = np.searchsorted(owner, np.arange(len(at)), side="right")
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(at) else ends
    some = ends > starts  # not those of marks alone
    return at[some], (ends - starts)[some], _word_hashes(folded[kept], starts, ends)[some]


def word_hashes(words: list[str]) -> np.ndarray:
    """Sorted hashes of the words in a list of words, as they are found in texts."""
    codes = np.frombuffer("\n".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.minimum(codes, CODES - 1)
    return np.unique(_words(codes, tables()[0][codes])[2])


def _line_statistics(text: str, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the line, COUNTS, STATISTICS) of every line of a text that is not blank."""
    table, _, hidden = tables()
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), CODES - 1)
    shown = ~hidden[codes]
    places = np.flatnonzero(shown)
    codes = codes[shown]
    bits = table[codes]
    has = lambda name: (bits & BIT[name]) > 0
    inner = np.flatnonzero(has("line"))
    starts, ends = np.concatenate([[0], inner + 1]), np.append(inner, len(codes))
    solid = ~has("space")

    def per_line(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask)])
        return upto[ends] - upto[starts]

    chars = per_line(solid)
    kept = chars > 0
    starts, ends, chars = starts[kept], ends[kept], chars[kept]
    if not len(starts):
        return np.empty(0, np.int64), np.empty((0, len(COUNTS)), np.int64), np.empty((0, len(STATISTICS)))
    line_of = lambda at: np.searchsorted(starts, at, side="right") - 1
    lines = len(starts)
    symbols = per_line(solid & ~has("plain"))
    digits = per_line(has("number"))
    blank = codes == 32
    beside = np.concatenate([[False], blank, [False]])
    marks = per_line(has("separator") | (blank & (beside[:-2] | beside[2:])))
    # changes of case and to digits within words, and marks that join letters
    letter, number, lower, upper = has("letter") & ~has("han"), has("number"), has("lower"), has("upper")
    turn = np.zeros(len(codes), bool)
    joins = has("joiner")
    turn[1:-1] = joins[1:-1] & letter[:-2] & letter[2:]
    turn[1:] |= (lower[:-1] & upper[1:]) | (letter[:-1] & number[1:]) | (number[:-1] & letter[1:])
    turns = per_line(turn)
    a, b = _runs(~has("cut"))
    longest = np.zeros(lines, np.int64)
    np.maximum.at(longest, line_of(a), b - a)
    at, letters, hashes = _words(codes, bits)
    own = line_of(at)
    words = np.bincount(own, minlength=lines)
    word_chars = np.bincount(own, letters, lines)
    slot = np.searchsorted(common, hashes)
    known = common[np.minimum(slot, len(common) - 1)] == hashes if len(common) else np.zeros(len(hashes), bool)
    common_words = np.bincount(own, known, lines)
    _, once = np.unique(hashes ^ (own.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True)
    kinds = np.bincount(own[once], minlength=lines)
    solid_at = np.flatnonzero(solid)
    last = np.searchsorted(solid_at, ends) - 1
    end, closer = has("end"), has("closer")
    final = solid_at[last]
    before = np.maximum(final - 1, starts)
    closes = end[final] | (closer[final] & end[before])
    n, some = chars.astype(float), np.maximum(words, 1).astype(float)
    spelled = (bits[at] & BIT["han"]) == 0  # the lengths of words of letters differ more in sentences than in lists
    counted = [np.bincount(own[spelled], letters[spelled].astype(float) ** power, lines) for power in range(3)]
    mean = counted[1] / np.maximum(counted[0], 1)
    spread = np.sqrt(np.maximum(counted[2] / np.maximum(counted[0], 1) - mean**2, 0)) / np.maximum(mean, 1)
    statistics = np.stack([common_words / some, np.log1p(word_chars / some), np.sqrt(symbols / n), np.sqrt(digits / n), np.log1p(marks / some), np.log1p(longest), np.where(words > 0, 1 - kinds / some, 0.0), np.sqrt(turns / n), spread], axis=1)
    return places[starts], np.stack([chars, words, word_chars, common_words, symbols, closes], axis=1).astype(np.int64), statistics


def texts_statistics(texts: list[str | None], common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, COUNTS, STATISTICS) of every line that is not blank, in order. Tags and addresses are taken off first."""
    out = [(np.empty(0, np.int64), np.empty((0, len(COUNTS)), np.int64), np.empty((0, len(STATISTICS))))]
    held, owners, size = [], [], 0

    def flush() -> None:
        nonlocal held, owners, size
        if held:
            begin = np.cumsum([0, *[len(h) + 1 for h in held]])
            at, counts, statistics = _line_statistics("\n".join(held), common)
            out.append((np.array(owners)[np.searchsorted(begin, at, side="right") - 1], counts, statistics))
        held, owners, size = [], [], 0

    for i, text in enumerate(texts):
        if not text:
            continue
        if "<" in text:
            text = TAG.sub(" ", text)
        if "://" in text:
            text = ADDRESS.sub(" ", text)
        at = 0
        while at < len(text):  # pieces of a long text end with a line
            end = len(text) if len(text) - at <= PIECE else text.find("\n", at + PIECE)
            end = len(text) if end < 0 else end
            held.append(text[at:end])
            owners.append(i)
            size += end - at
            at = end + 1
            if size >= PIECE:
                flush()
    flush()
    return tuple(map(np.concatenate, zip(*out)))


@dataclass
class Mixture:
    """A Gaussian mixture over standardized statistics; forms: the form of each component."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    forms: list[str]

    def logs(self) -> np.ndarray:
        """The logarithms of the weighted densities as a linear function of the terms of a line: see terms."""
        d = len(self.center)
        precision = np.linalg.inv(self.covariances)
        shift = np.einsum("kij,kj->ki", precision, self.means)
        constant = np.log(self.weights) - 0.5 * (np.linalg.slogdet(self.covariances)[1] + d * np.log(2 * np.pi) + np.einsum("ki,ki->k", shift, self.means))
        i, j = np.triu_indices(d)
        squares = np.where(i == j, -0.5, -1.0) * precision[:, i, j]
        return np.concatenate([constant[:, None], shift, squares], axis=1).T

    def terms(self, statistics: np.ndarray) -> np.ndarray:
        """1, the standardized statistics, and their products, of each line."""
        x = (statistics - self.center) / self.scale
        i, j = np.triu_indices(x.shape[1])
        return np.concatenate([np.ones((len(x), 1)), x, x[:, i] * x[:, j]], axis=1)

    def responsibilities(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(share of each component in each line, logarithm of each line's density)."""
        log = terms @ self.logs()
        top = log.max(axis=1, keepdims=True)
        p = np.exp(log - top)
        total = p.sum(axis=1, keepdims=True)
        return p / total, (top + np.log(total))[:, 0]


def _statistics(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("statistics").flatten()).reshape(-1, len(STATISTICS))


def fit(lines: DataFrame, shown: np.ndarray, labels: list[tuple[str, str]], steps: int = MOST_STEPS, gain: float = GAIN) -> Mixture:
    """The mixture by expectation-maximization over all lines of `lines` (statistics: those of all lines of a row).
    Components begin at the kinds of the examples (shown; labels: form and kind); a step is one pass over the data, whose
    sums are added up in a tree. It ends when a step gains less than `gain` in the mean logarithm of the densities.
    Afterwards a component has the form of the examples it explains."""
    d = len(STATISTICS)

    def moments(b: pa.RecordBatch) -> np.ndarray:
        x = _statistics(b)
        return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    table = lines.select("statistics")
    first = tree_sum(table, 1 + 2 * d, moments)
    n_lines = first[0]
    center = first[1 : 1 + d] / n_lines if n_lines else shown.mean(axis=0)
    scale = np.sqrt(np.maximum(first[1 + d :] / n_lines - center**2, 0)) if n_lines else shown.std(axis=0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    kinds = list(dict.fromkeys(labels))
    member = np.array([kinds.index(x) for x in labels])
    start = (shown - center) / scale
    means = np.array([start[member == k].mean(axis=0) for k in range(len(kinds))])
    model = Mixture(center, scale, np.full(len(kinds), 1 / len(kinds)), means, np.tile(np.eye(d) * START, (len(kinds), 1, 1)), [f for f, _ in kinds])
    own = model.terms(shown)
    width, (i, j) = own.shape[1], np.triu_indices(d)
    last = -np.inf
    for _ in range(steps if n_lines else 0):

        def sums(b: pa.RecordBatch, model: Mixture = model) -> np.ndarray:
            total, x = np.zeros((len(model.weights), width)), _statistics(b)
            log = 0.0
            for at in range(0, len(x), 16384):
                terms = model.terms(x[at : at + 16384])
                r, logs = model.responsibilities(terms)
                total += r.T @ terms
                log += logs.sum()
            return np.append(total.ravel(), log)

        found = tree_sum(table, len(kinds) * width + 1, sums)
        total, mean_log = found[:-1].reshape(len(kinds), width), found[-1] / n_lines
        np.add.at(total, member, own * max(1.0, ANCHOR * n_lines / len(shown)))
        n = total[:, 0]
        seen = n > 1e-6 * n.sum()  # what explains no lines stays at its examples
        share = total / np.maximum(n, 1e-300)[:, None]
        mean = np.where(seen[:, None], share[:, 1 : 1 + d], model.means)
        second = np.zeros((len(kinds), d, d))
        second[:, i, j] = second[:, j, i] = share[:, 1 + d :]
        spread = np.where(seen[:, None, None], second - mean[:, :, None] * mean[:, None, :], model.covariances)
        covariance = (n[:, None, None] * spread + PRIOR_LINES * START * np.eye(d)) / (n[:, None, None] + PRIOR_LINES) + np.eye(d) * RIDGE
        weight = np.maximum(n / n.sum(), 1e-6)
        model = Mixture(center, scale, weight / weight.sum(), mean, covariance, model.forms)
        if mean_log - last < gain:
            break
        last = mean_log
    explained = model.responsibilities(own)[0]
    forms = []
    for k, form in enumerate(model.forms):
        votes = {f: explained[[g == f for g, _ in labels], k].mean() for f in dict.fromkeys(f for f, _ in labels)}
        forms.append(max(votes, key=votes.get) if max(votes.values()) > 0.01 else form)
    model.forms = forms
    return model


def common_hashes(common_words: DataFrame) -> np.ndarray:
    """Hashes of all common words, of which there may be at most MOST_WORDS."""
    words = [r["word"] for r in common_words.select("word").filter(F.col("word").isNotNull()).distinct().limit(MOST_WORDS + 1).collect()]
    if len(words) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} common words")
    return word_hashes([*words, *MORE_WORDS.split()])


def line_statistics(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, filled, counts, statistics) of every row of docs with a doc_id: if its text is not blank, and COUNTS and
    STATISTICS of its lines that are not blank, one line after the other."""
    common = common_hashes(common_words)
    used = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            owner, counts, statistics = texts_statistics(texts, common)
            lines = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
            columns = [pa.ListArray.from_arrays(pa.array((lines * x.shape[1]).astype(np.int32)), pa.array(x.ravel())) for x in (counts, statistics)]
            filled = pa.array([t is not None and not (t == "" or t.isspace()) for t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), filled, *columns], names=["doc_id", "filled", "counts", "statistics"])

    kind = used.schema["doc_id"].dataType.simpleString()
    return used.mapInArrow(run, f"doc_id {kind}, filled boolean, counts array<bigint>, statistics array<double>")


def document_statistics(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, words, mean_word_length, symbol_ratio, ending_share, common_share) of every document: see quality."""
    at = lambda i: F.filter("counts", lambda _, j: F.pmod(j, F.lit(len(COUNTS))) == i)
    total = {c: F.aggregate(at(i), F.lit(0).cast("bigint"), lambda a, b: a + b) for i, c in enumerate(COUNTS)}
    sums = line_statistics(docs, common_words).select("doc_id", (F.size("counts") / len(COUNTS)).alias("lines"), *[c.alias(n) for n, c in total.items()])
    part = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    numbers = {"words": F.col("words"), "mean_word_length": part("word_chars", "words"), "symbol_ratio": part("symbol_chars", "chars"), "ending_share": part("ends", "lines"), "common_share": part("common_words", "words")}
    each = sums.select("doc_id", *[c.alias(n) for n, c in numbers.items()])
    return each.groupBy("doc_id").agg(F.min(F.struct(*numbers)).alias("d")).select("doc_id", "d.*")


def quality(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, words, mean_word_length, symbol_ratio, ending_share, common_share, prose, list, table, junk, form) of
    every document; the last five are the shares of its characters in lines of each form and the form of the largest.

    docs: (doc_id, text); common_words: (word) of whatever languages. Method: statistics of each line, standardized,
    are modelled by a Gaussian mixture fitted to all lines by expectation-maximization; its components are named by
    inspected examples, and each line goes to the form of the largest posterior. Markup tags, addresses, emoji and
    invisible characters are taken off first. A document is natural prose (form prose) unless over half of its characters
    are in other lines.

    Null, empty and blank texts have no lines: counts of 0, null shares and form. A text of which nothing is left is
    junk. Whole texts of any length are used. Rows without doc_id are left out; rows repeated with one doc_id are one
    document, of several texts the one of the least statistics. Other columns are ignored. Empty docs give no rows.
    """
    lines = materialize(line_statistics(docs, common_words))
    _, _, shown = texts_statistics([t for _, _, t in EXAMPLES], common_hashes(common_words))
    model = fit(lines, shown, [(f, k) for f, k, _ in EXAMPLES])
    names = list(dict.fromkeys(f for f, _, _ in EXAMPLES))
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = ["words", "mean_word_length", "symbol_ratio", "ending_share", "common_share", *names]

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        belongs = np.array([[f == n for n in names] for f in model.forms], float)
        for b in batches:
            x = _statistics(b)
            counts = np.asarray(b.column("counts").flatten()).reshape(-1, len(COUNTS))
            form = np.concatenate([np.empty(0, np.int64), *[np.argmax(model.responsibilities(model.terms(x[at : at + 16384]))[0] @ belongs, axis=1) for at in range(0, len(x), 16384)]])
            lengths = np.asarray(b.column("statistics").value_lengths()) // len(STATISTICS)
            doc = np.repeat(np.arange(b.num_rows), lengths)
            total = lambda w: np.bincount(doc, w, b.num_rows)
            chars, words, word_chars, common, symbols, ends = (total(counts[:, i]) for i in range(len(COUNTS)))
            shares = [total(np.where(form == f, counts[:, 0], 0)) / np.where(chars > 0, chars, np.nan) for f in range(len(names))]
            with np.errstate(invalid="ignore", divide="ignore"):
                columns = [words, word_chars / words, symbols / chars, ends / lengths, common / words, *shares]
            bare = (chars == 0) & np.asarray(b.column("filled"))
            columns[-1] = np.where(bare, 1.0, columns[-1])
            others = [i for i, n in enumerate(names) if n != "prose"]
            stack = np.stack([columns[5 + i] for i in others])
            largest = np.array([names[i] for i in others], object)[np.argmax(np.nan_to_num(stack, nan=-1.0), axis=0)]
            verdict = np.where(bare, "junk", np.where(columns[5 + names.index("prose")] < 0.5, largest, "prose"))
            verdict = pa.array([v if c > 0 or bad else None for v, c, bad in zip(verdict, chars, bare)], pa.string())
            out = [pa.array(np.asarray(c, float), pa.float64(), from_pandas=True) for c in columns]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *out, verdict], names=["doc_id", *numbers, "form"])

    judged = lines.mapInArrow(classify, f"doc_id {kind}, {', '.join(n + ' double' for n in numbers)}, form string")
    once = judged.groupBy("doc_id").agg(F.min(F.struct(*numbers, "form")).alias("d")).select("doc_id", "d.*")
    return once.withColumn("words", F.col("words").cast("bigint"))
