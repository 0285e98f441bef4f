"""The language of short texts: by script, and within Latin script by a character n-gram model.

The texts of a batch are one array of code points. Scripts are counted in one pass; in Latin
script each letter with its two neighbours is a trigram, each word one more feature, and a
language's score is the sum of their log probabilities, gathered from a hashed table and summed
by text. The model is trained here, from the short texts below. Capitalised words inside a text
are taken for names and quoted passages for quotations; neither has a say.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

from pathloom.llm.charform import mix

# Everyday sentences and frequent words of each language in Latin script.
SEEDS = {
    "en": "all human beings are born free and equal in dignity and rights they are endowed with reason and conscience and should act towards one another in a spirit of brotherhood the first thing i have to do is to open this and then find what you need before it is too late please call me when you are there because we would like to know how many of them are left and where they will be kept who could have been with him at that time do not forget your keys if the weather is not good search for it use this one look at these start again stop here save the file send it to her remind me near the house from which it came let us go over there until we get back only after some other people said so just like my brother about their new work into our own town an old friend tell check set buy pay around between under through during without within along across against toward upon while since always never something nothing can may help answer today tomorrow day night city she he his",
    "es": "todos los seres humanos nacen libres e iguales en dignidad y derechos y dotados como están de razón y conciencia deben comportarse fraternalmente los unos con los otros lo primero que tengo que hacer es abrir esto y luego buscar lo que necesitas antes de que sea tarde por favor llámame cuando estés allí porque queremos saber cuántos de ellos quedan y dónde se van a guardar quién podría haber estado con él en ese momento no olvides tus llaves si el tiempo no es bueno busca abre llama usa mira empieza para pide paga dile escribe avisa recuérdame ayuda quiero ver mi su se la las del al una un unos con sobre hasta desde entre también muy más pero sin hay esta este ese aquí ahora nosotros después sólo otra gente dijo así mi hermano su nuevo trabajo nuestra ciudad cerca envíe ponga compra según durante mientras contra hacia bajo ante tras siempre nunca algo nada quiere puede ella nosotras está ser casa día hoy mañana lo siento puedo ayudar responder",
    "fr": "tous les êtres humains naissent libres et égaux en dignité et en droits ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité la première chose que je dois faire est d'ouvrir ceci puis de trouver ce dont vous avez besoin avant qu'il ne soit trop tard appelez moi quand vous serez là parce que nous voulons savoir combien il en reste et où elles seront gardées qui aurait pu être avec lui à ce moment n'oubliez pas vos clés si le temps n'est pas beau cherche ouvre avec pour dans sur au aux du des une est sont été mais sans chez très aussi cette ces leur notre votre merci beaucoup il faut veut peut va faire voir avant après ville maison jour ne pas plus rien toujours jamais pendant depuis vers contre sous entre je désolé puis répondre",
    "de": "alle menschen sind frei und gleich an würde und rechten geboren sie sind mit vernunft und gewissen begabt und sollen einander im geiste der brüderlichkeit begegnen das erste was ich tun muss ist dies zu öffnen und dann zu finden was du brauchst bevor es zu spät ist bitte ruf mich an wenn du da bist weil wir wissen wollen wie viele davon noch übrig sind und wo sie aufbewahrt werden wer hätte zu dieser zeit bei ihm sein können vergiss deine schlüssel nicht wenn das wetter nicht gut ist suche öffne mit für auf dem den des ein eine einen einem einer nicht auch aber ohne sehr mehr hier jetzt uns unser euer vom zum zur bei nach vor über unter zwischen gegen während seit schon immer nie etwas nichts leider kann darf helfen antworten heute morgen stadt haus tag",
    "it": "tutti gli esseri umani nascono liberi ed eguali in dignità e diritti essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza la prima cosa che devo fare è aprire questo e poi trovare quello che ti serve prima che sia troppo tardi per favore chiamami quando sei lì perché vogliamo sapere quanti ne restano e dove saranno tenuti chi poteva essere con lui in quel momento non dimenticare le chiavi se il tempo non è buono cerca apri con nel nella della dello degli delle alla allo sul sulla il lo i gli una uno anche ma senza molto più qui adesso noi nostro vostro dopo prima città casa giorno oggi domani voglio vedere mandare pagare mi dispiace posso aiutare rispondere",
    "pt": "todos os seres humanos nascem livres e iguais em dignidade e em direitos dotados de razão e de consciência devem agir uns para com os outros em espírito de fraternidade a primeira coisa que tenho de fazer é abrir isto e depois encontrar o que você precisa antes que seja tarde por favor ligue quando estiver lá porque queremos saber quantos deles ainda restam e onde serão guardados quem poderia ter estado com ele naquele momento não esqueça as suas chaves se o tempo não estiver bom procure abra com na no nas nos da do das dos ao à uma um também mas sem muito mais aqui agora nós nosso depois cidade casa dia hoje amanhã quero ver enviar pagar desculpe posso ajudar responder são está até você então",
    "nl": "alle mensen worden vrij en gelijk in waardigheid en rechten geboren zij zijn begiftigd met verstand en geweten en behoren zich jegens elkander in een geest van broederschap te gedragen het eerste wat ik moet doen is dit openen en dan vinden wat je nodig hebt voordat het te laat is bel me als je er bent want we willen weten hoeveel er nog over zijn en waar ze bewaard worden wie had toen bij hem kunnen zijn vergeet je sleutels niet als het weer niet goed is zoek open met voor op de het een niet ook maar zonder zeer meer hier nu ons onze van naar bij na over onder tussen tegen tijdens sinds altijd nooit iets niets helaas kan mag helpen antwoorden vandaag morgen stad huis dag",
    "sv": "alla människor är födda fria och lika i värde och rättigheter de är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap det första jag måste göra är att öppna detta och sedan hitta vad du behöver innan det är för sent ring mig när du är där för vi vill veta hur många av dem som är kvar och var de ska förvaras glöm inte dina nycklar om vädret inte är bra sök öppna med för på den det en ett inte också men utan mycket mer här nu oss vår från till hos efter över under mellan mot sedan alltid aldrig något inget tyvärr kan får hjälpa svara idag imorgon staden huset dagen",
    "pl": "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa pierwszą rzeczą którą muszę zrobić jest otworzyć to a potem znaleźć czego potrzebujesz zanim będzie za późno proszę zadzwoń do mnie kiedy tam będziesz bo chcemy wiedzieć ile ich jeszcze zostało i gdzie będą przechowywane nie zapomnij kluczy jeśli pogoda nie jest dobra szukaj otwórz z dla na nie też ale bez bardzo więcej tu teraz nas nasz od przed po nad pod między przeciw zawsze nigdy coś nic niestety mogę pomóc odpowiedzieć dziś jutro miasto dom dzień się",
    "tr": "bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler yapmam gereken ilk şey bunu açmak ve sonra çok geç olmadan ihtiyacın olanı bulmak lütfen orada olduğunda beni ara çünkü kaç tane kaldığını ve nerede saklanacağını bilmek istiyoruz hava iyi değilse anahtarlarını unutma için ile bir bu şu da de ama çok daha burada şimdi biz bizim sonra önce her zaman hiç maalesef yardım edemem cevap bugün yarın şehir ev gün",
    "id": "semua orang dilahirkan merdeka dan mempunyai martabat dan hak yang sama mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan hal pertama yang harus saya lakukan adalah membuka ini lalu mencari apa yang anda butuhkan sebelum terlambat tolong hubungi saya ketika anda di sana karena kami ingin tahu berapa banyak yang tersisa dan di mana akan disimpan jangan lupa kunci jika cuaca tidak baik untuk dengan pada ke dari itu tidak juga tetapi tanpa sangat lebih sini sekarang kita setelah selalu tidak pernah maaf bisa membantu menjawab hari kota rumah",
    "vi": "tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu việc đầu tiên tôi phải làm là mở cái này rồi tìm những gì bạn cần trước khi quá muộn vui lòng gọi cho tôi khi bạn ở đó vì chúng tôi muốn biết còn lại bao nhiêu và sẽ được giữ ở đâu không với cho của các một này cũng nhưng rất hơn đây bây giờ sau luôn xin lỗi có thể giúp trả lời hôm nay ngày mai thành phố nhà ngày",
}
# Scripts by their blocks (hexadecimal), each with the language it stands for.
SCRIPTS = {
    "zh": "3400-4DBF 4E00-9FFF", "ja": "3041-30FF 31F0-31FF", "ko": "AC00-D7A3 1100-11FF", "ru": "0400-052F", "el": "0370-03FF 1F00-1FFF", "he": "0590-05FF", "ar": "0600-06FF 0750-077F",
    "hi": "0900-097F", "bn": "0980-09FF", "ta": "0B80-0BFF", "th": "0E00-0E7F", "ka": "10A0-10FF", "hy": "0530-058F", "am": "1200-137F", "my": "1000-109F", "km": "1780-17FF",
}
LATIN, SCRIPT = list(SEEDS), list(SCRIPTS)
NAMES = LATIN + SCRIPT
#: Buckets of the hashed features, weight of a count that wasn't seen, and what a known word counts beside its trigrams.
_BITS, UNSEEN, WORD_WEIGHT = 17, 0.4, 2.0
#: Evidence (log odds) by which another language must lead before it is preferred, and what one ideograph weighs in words.
MARGIN, IDEOGRAPH = 3.0, 1 / 1.5
_QUOTED = re.compile(r"\"[^\"\x00]*\"|“[^”\x00]*”|«[^»\x00]*»|「[^」\x00]*」|『[^』\x00]*』|《[^》\x00]*》|‘[^’\x00]*’")
_LETTER = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its script (0 none, 1 Latin or unknown, 2 and up as in SCRIPT); whether it is a capital."""
    every = "".join(map(chr, range(0xD800))) + " " * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    script, upper = np.zeros(0x110000, np.uint8), np.zeros(0x110000, bool)
    for m in _LETTER.finditer(every):
        script[m.start() : m.end()] = 1
    for k, blocks in enumerate(SCRIPTS.values()):
        for block in blocks.split():
            a, b = (int(x, 16) for x in block.split("-"))
            script[a : b + 1] = np.where(script[a : b + 1] > 0, k + 2, 0)
    for cp in (*range(0x41, 0x530), *range(0x1E00, 0x2000)):
        upper[cp] = unicodedata.category(chr(cp)) in ("Lu", "Lt")
    return script, upper


def _features(text: str) -> tuple[np.ndarray, ...]:
    """Buckets of a joined text's trigrams and words, the text each is from, and the positions' scripts and texts."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    script, upper = _tables()
    kind, text_of = script[codes], np.cumsum(codes == 0)
    letter = np.flatnonzero(kind == 1)
    first = np.ones(len(letter), bool)
    first[1:] = letter[1:] != letter[:-1] + 1
    last = np.append(first[1:], True) if len(letter) else first
    word = np.cumsum(first) - 1
    head, tail = letter[first], letter[last]
    owner = text_of[head]
    capital = upper[codes[head]]
    opens = np.ones(len(head), bool)
    opens[1:] = owner[1:] != owner[:-1]
    whole = capital & upper[codes[np.minimum(head + 1, tail)]]
    said = ~capital | opens | whole
    kept = said[word]
    low = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    low = (low if len(low) == len(codes) else codes).astype(np.uint64)
    mid = low[letter]
    before = np.where(first, np.uint64(32), low[np.maximum(letter, 1) - 1])
    after = np.where(last, np.uint64(32), low[np.minimum(letter + 1, len(low) - 1)])
    trigram = mix((before << np.uint64(42) | mid << np.uint64(21) | after) + np.uint64(7))
    place = (letter - head[word]).astype(np.uint64) if len(letter) else mid
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(mid << np.uint64(32) | place), dtype=np.uint64)])
    ends = np.flatnonzero(last) + 1
    words = mix(total[ends] - total[np.flatnonzero(first)] + np.uint64(11))
    shift = np.uint64(64 - _BITS)
    return (trigram[kept] >> shift).astype(np.int64), text_of[letter][kept], (words[said] >> shift).astype(np.int64), owner[said], kind, text_of


@lru_cache(maxsize=1)
def _model() -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of trigrams and of words per language, as differences from the best unseen one."""
    grams, words = np.zeros((1 << _BITS, len(LATIN))), np.zeros((1 << _BITS, len(LATIN)))
    for k, text in enumerate(SEEDS.values()):
        g, _, w, *_ = _features(text)
        np.add.at(grams[:, k], g, 1)
        words[np.unique(w), k] = 1
    rate = (grams + UNSEEN) / (grams.sum(axis=0) + UNSEEN * np.count_nonzero(grams.any(axis=1)))
    known = words.sum(axis=1, keepdims=True)
    weight = np.where(words > 0, WORD_WEIGHT / np.maximum(known, 1), 0)
    return np.log(rate).astype(np.float32), weight.astype(np.float32)


def scores(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per text: log probability of each Latin-script language; number of said words, and of letters per script."""
    joined = _QUOTED.sub(" ", "\x00".join(t.replace("\x00", " ") for t in texts))
    grams, of_gram, words, of_word, kind, text_of = _features(joined)
    by_gram, by_word = _model()
    n, k = len(texts), len(LATIN)
    out = np.zeros((n, k))
    for value, owner in ((by_gram[grams], of_gram), (by_word[words], of_word)):
        if len(owner):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            out[owner[starts]] += np.add.reduceat(value, starts, axis=0)
    letters = np.bincount(text_of * 32 + kind, minlength=32 * n).reshape(n, 32)[:, : len(SCRIPT) + 2].copy()
    letters[:, 0], letters[:, 1] = 0, np.bincount(of_word, minlength=n)
    return out, letters


def languages(texts: list[str], expected: list[str | None] | None = None) -> list[str | None]:
    """The language of every text, None where nothing tells; ``expected`` stands unless another one leads by MARGIN."""
    if not texts:
        return []
    latin, letters = scores(texts)
    words = letters.astype(float)
    zh, ja = SCRIPT.index("zh") + 2, SCRIPT.index("ja") + 2
    both = words[:, zh] + words[:, ja]
    kana = words[:, ja] > 0.1 * both
    words[:, zh], words[:, ja] = np.where(kana, 0, both * IDEOGRAPH), np.where(kana, both * IDEOGRAPH, 0)
    for k in range(2, words.shape[1]):  # other scripts in words of about five letters
        if k not in (zh, ja):
            words[:, k] /= 2.0 if SCRIPT[k - 2] == "ko" else 5.0
    top = words.argmax(axis=1)
    best = latin.argmax(axis=1)
    order = np.sort(latin, axis=1)
    lead = order[:, -1] - order[:, -2]
    out: list[str | None] = []
    for i, kind in enumerate(top):
        want = expected[i] if expected else None
        if words[i, kind] == 0:
            out.append(None)
        elif kind > 1:
            out.append(SCRIPT[kind - 2])
        elif letters[i, 1] < 2:  # a single word could be of any of them
            out.append(want if want in SEEDS else None)
        elif want in SEEDS:
            out.append(want if latin[i, best[i]] - latin[i, LATIN.index(want)] < MARGIN else LATIN[best[i]])
        else:
            out.append(LATIN[best[i]] if lead[i] > 0 else None)
    return out
