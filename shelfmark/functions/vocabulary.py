"""The word lists and tables that matching depends on."""

SMALL = "the a an of and or to in on at for by with from".split()
FORMAT = (
    "book books disc discs disk dvd dvds cd cds video videos vhs bluray paperback hardcover hardback softcover kindle ebook audiobook audio novel "
    "edition editions ed edn anniversary illustrated unabridged abridged deluxe reprint revised expanded"
).split()
QUESTION = "is are was can could may banned ban allowed permitted prohibited".split()
ROLE = "jr sr dr mr sir dame prof rev author authors editor editors ed illustrator illustrators translator translators".split()
ASKING = "i we use read teach class ok okay appropriate suitable".split()
PUBLISHER = "company press publisher publishers books inc".split()
SERIES_DESCRIBED = "saga chronicles complete adventures stories mystery mysteries tales novels".split()
PLACEHOLDER = (
    "unknown unknownauthor anonymous anon various variousauthors variousartists multipleauthors noauthor unknownartist unknownartists na none nil "
    "notknown notlisted notstated notavailable tbd tba"
).split()
ARTICLES = "the a an le la les el los las il der die das".split()

UNITS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 20 + 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split())}
ORDINALS = (
    {w: i + 1 for i, w in enumerate("first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split())}
    | {w: 20 + 10 * i for i, w in enumerate("twentieth thirtieth fortieth fiftieth sixtieth seventieth eightieth ninetieth".split())}
    | {"hundredth": 100, "thousandth": 1000}
)
MISSPELT = {
    "ninteen": "nineteen", "ninty": "ninety", "fourty": "forty", "eigth": "eighth", "eigthy": "eighty", "twelth": "twelfth",
    "nineth": "ninth", "fith": "fifth", "fourtieth": "fortieth", "eightteen": "eighteen",
}
LABELS = {
    word: key
    for key, words in {
        "book": "book books bk bks volume volumes vol vols number no nos num", "grade": "grade grades gr class standard std", "part": "part parts pt",
        "unit": "unit units", "chapter": "chapter chapters ch chap", "level": "level levels lvl", "season": "season seasons",
        "episode": "episode episodes ep", "edition": "edition ed edn", "lesson": "lesson", "module": "module", "stage": "stage", "act": "act",
        "issue": "issue", "series": "series", "year": "year",
    }.items()
    for word in words.split()
}

IRREGULAR = {"woman": "women", "man": "men", "child": "children", "mouse": "mice", "person": "people", "foot": "feet", "tooth": "teeth", "goose": "geese"}
BRITISH = {
    "pyjamas": "pajamas", "pyjama": "pajama", "grey": "gray", "mum": "mom", "mummy": "mommy", "aeroplane": "airplane", "programme": "program",
    "catalogue": "catalog", "dialogue": "dialog", "jewellery": "jewelry", "defence": "defense", "licence": "license", "plough": "plow", "tyre": "tire",
    "moustache": "mustache", "mould": "mold", "sceptic": "skeptic", "aluminium": "aluminum", "cosy": "cozy", "travelled": "traveled", "traveller": "traveler",
}
ABBREVIATED = {"mr": "mister", "dr": "doctor", "st": "saint", "mt": "mount"}

#: Fields in the order of results, and the weights and classes of the kinds of hits, in hundredths.
FIELDS = ("title", "author", "memo", "isbn", "type", "banned_by")
FIELD_WEIGHT = {"title": 300, "author": 200, "memo": 100, "isbn": 300, "type": 50, "banned_by": 50}
KIND_WEIGHT = {"exact": 100, "alt": 90, "cross": 75, "prefix": 80, "compound": 90, "edit1": 60, "edit2": 40, "loose": 30, "completion": 70}
KIND_CLASS = {"exact": 3, "alt": 3, "cross": 3, "prefix": 3, "compound": 2, "edit1": 1, "edit2": 1, "loose": 0, "completion": 3}
