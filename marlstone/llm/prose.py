"""What prose looks like, language by language: its function words one by one, and samples that its other shares come from.

A language's function-word profile gives each word a share by its place in the list, which is in the order of frequency,
under Zipf's law. Shares of word kinds and character classes are estimated from the sample, together with a prior for all
prose that weighs as much as PRIOR_WORDS words (see structure). Samples are bounded: SAMPLE_CHARS characters each.
"""

from __future__ import annotations

import numpy as np

#: Characters of a sample that estimates use.
SAMPLE_CHARS = 2_000

# Frequent function words, the most frequent ones first.
FREQUENT = {
    "en": """the of and to a in is that it was for on are as with they at be this from have or by had not but what all were when we there can an which
        their if will each about how up out them then she some so these would other into has more her no than been its who now""",
    "de": """der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am
        sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn""",
    "fr": """de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son cette aux ou mais comme on tout nous sa
        été leur bien être deux même ces ont ses sans entre après""",
    "es": """de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta
        ser son dos también fue había era muy hasta desde está""",
    "it": """di e il la che in a per un è del non una le si da con i della al come dei nel sono gli alla più anche ma lo ha dal se delle o nella su ci questo
        era tra loro essere ed dopo quando dove perché mentre senza stato stata hanno lui lei ogni molto""",
    "pt": """de a o e que do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito nos já eu também só pelo
        pela até isso ela entre depois sem mesmo aos seus quem nas me esse eles você foi ser está era são tem""",
    "nl": """de en van het een in is dat op te zijn met voor niet aan er die om dan maar ook als bij nog uit door naar heeft hij ze wordt over of was had werd
        dit tot zou kan geen al meer wel worden toen omdat terwijl zonder hun we je""",
    "pl": """i w na z się nie że do to jest o jak za po co tak od ale dla ten przez tym czy już był była było być może tylko gdy ich jego jej tego który
        która które oraz lub pod nad przed są przy ze jako niż bez więc aby ponieważ kiedy""",
    "ru": """и в не на что с он как это по но из у за к от так о же бы то до для все было была был если или когда только ее их его мы вы они она я уже чтобы
        при нет со во где есть потому под над без после перед тоже очень там этот эта эти который""",
    "el": """και το να του η ο της με που τα για την στο από είναι τον οι σε ότι τη των θα δεν στη στην μας τους ένα μια αυτό ή αλλά ως στις στον όταν αν
        πολύ όπως κατά μετά πριν χωρίς επειδή γιατί ήταν έχει έχουν τις στα μόνο""",
    "vi": """và của là có được cho không các những một trong người để với này đã khi từ như về ra đến lại nhưng phải thì mà rằng nếu cũng rất vào trên hay
        còn bị sẽ do vì tại theo sau đang nên ở đó hơn""",
    "zh": """的 了 是 在 不 和 有 我 他 这 个 们 上 到 也 就 说 要 着 把 那 为 而 与 之 以 于 从 被 但 并 其 她 它 你 都 很 还 后 因 所 没 会""",
}

# The Universal Declaration of Human Rights, articles 1 and 3.
SAMPLES = {
    "en": """All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another
        in a spirit of brotherhood. Everyone has the right to life, liberty and security of person.""",
    "de": """Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der
        Brüderlichkeit begegnen. Jeder hat das Recht auf Leben, Freiheit und Sicherheit der Person.""",
    "fr": """Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers
        les autres dans un esprit de fraternité. Tout individu a droit à la vie, à la liberté et à la sûreté de sa personne.""",
    "es": """Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse
        fraternalmente los unos con los otros. Todo individuo tiene derecho a la vida, a la libertad y a la seguridad de su persona.""",
    "it": """Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli
        altri in spirito di fratellanza. Ogni individuo ha diritto alla vita, alla libertà ed alla sicurezza della propria persona.""",
    "pt": """Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em
        espírito de fraternidade. Todo o indivíduo tem direito à vida, à liberdade e à segurança pessoal.""",
    "nl": """Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander
        in een geest van broederschap te gedragen. Een ieder heeft het recht op leven, vrijheid en onschendbaarheid van zijn persoon.""",
    "pl": """Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec
        innych w duchu braterstwa. Każdy człowiek ma prawo do życia, wolności i bezpieczeństwa swej osoby.""",
    "ru": """Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга
        в духе братства. Каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность.""",
    "el": """Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να
        συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης. Κάθε άτομο έχει δικαίωμα στη ζωή, την ελευθερία και την προσωπική του ασφάλεια.""",
    "vi": """Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền. Mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần
        phải đối xử với nhau trong tình bằng hữu. Mọi người đều có quyền sống, quyền tự do và an toàn cá nhân.""",
    "zh": """人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神互相对待。人人有权享有生命、自由和人身安全。""",
}
LANGUAGES = tuple(FREQUENT)


def zipf_profiles(more: dict[str, str]) -> tuple[dict[str, int], np.ndarray]:
    """Each function word's number, and each language's shares of them all, a row a language.

    A word's share falls with its place in FREQUENT; the words of `more`, which have no order, share the places behind.
    """
    numbers: dict[str, int] = {}
    shares: list[dict[int, float]] = []
    for language in LANGUAGES:
        first = list(dict.fromkeys(FREQUENT[language].split()))
        rest = [w for w in dict.fromkeys(more.get(language, "").split()) if w not in first]
        weights = [1 / (rank + 1) for rank in range(len(first))] + [1 / (len(first) + len(rest) / 2 + 1)] * len(rest)
        shares.append({numbers.setdefault(w, len(numbers)): x / sum(weights) for w, x in zip(first + rest, weights, strict=True)})
    out = np.zeros((len(shares), len(numbers)))
    for row, of in zip(out, shares, strict=True):
        row[list(of)] = list(of.values())
    return numbers, out
