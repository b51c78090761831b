"""Fixed values of the two languages, `mn` (Khalkha Mongolian) and `kz` (Kazakh), and of the token vocabulary.

They must equal the published lexicon for right results, so they are stated as plain text.
"""

LANGS = ("mn", "kz")

# Number words. Mongolian words come as standalone and attributive forms, Kazakh ones have one form.
MN_ONES = "нэг хоёр гурав дөрөв тав зургаа долоо найм ес".split()
MN_ONES_ATTR = "нэг хоёр гурван дөрвөн таван зургаан долоон найман есөн".split()
MN_TENS = "арав хорь гуч дөч тавь жар дал ная ер".split()
MN_TENS_ATTR = "арван хорин гучин дөчин тавин жаран далан наян ерэн".split()
MN_HUNDRED = ("зуу", "зуун")
MN_SCALES = (("мянга", "мянган"), ("сая", "сая"), ("тэрбум", "тэрбум"), ("их наяд", "их наяд"))
KZ_ONES = "бір екі үш төрт бес алты жеті сегіз тоғыз".split()
KZ_TENS = "он жиырма отыз қырық елу алпыс жетпіс сексен тоқсан".split()
KZ_HUNDRED = ("жүз", "жүз")
KZ_SCALES = (("мың", "мың"), ("миллион", "миллион"), ("миллиард", "миллиард"))

# Ordinal suffixes. In Mongolian the last of these letters in the word decides.
MN_BACK_LETTERS, MN_FRONT_LETTERS = "аоуь", "эөүие"
MN_ORDINAL_BACK, MN_ORDINAL_FRONT = "дугаар", "дүгээр"
KZ_ORDINAL = "нші"

# What a Mongolian denominator ends in, after a front and after a back ordinal, and what follows a Kazakh one.
MN_DENOMINATOR_FRONT, MN_DENOMINATOR_BACK, KZ_DENOMINATOR = "ийн", "ын", "ден"

# Endings behind a number and a dash that make it an ordinal, or take its attributive form.
ORDINAL_ENDING, ORDINAL_ENDINGS_MN, ORDINAL_ENDINGS_KZ, GENITIVE_ENDINGS = "р", ("дугаар", "дүгээр", "дахь"), ("ші", "шы"), ("ны", "ний", "ын", "ийн")

# The letters with which a word must begin that makes the number before it attributive.
ATTRIBUTIVE_BEFORE = "а-яёәғқңұһі"

# The letters of Roman numerals, and the pattern of a well-formed one.
ROMAN_LETTERS = "MDCLXVI"
ROMAN_NUMERAL = r"^(?=.)M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})$"

# How dates, times, temperatures, percentages, decimals, fractions, phone numbers and ranges are written.
# S stands for white space of any kind; digits are ASCII, other decimal digits are made ASCII before.
WRITTEN = {
    "thousands": r"(?<=[0-9])[ ,](?=[0-9]{3})",
    "date_ymd": r"([0-9]{4})[/.\-]([0-9]{1,2})[/.\-]([0-9]{1,2})",
    "date_dmy": r"([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]{4})",
    "time": r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?",
    "temperature": r"(-?)([0-9]+)°S*([CcFf])?",
    "percent": r"([0-9]+)%",
    "decimal": r"([0-9]+)\.([0-9]+)",
    "fraction": r"([0-9]{1,2})/([0-9]{1,2})",
    "phone": r"\+[0-9](?:[0-9-]|S){6,15}[0-9]",
    "range": r"([0-9]+)S*[-–—]S*([0-9]+)",
    "cardinal": r"[0-9]+",
}

# Words around numbers.
WORDS = {
    "mn": {
        "zero": "тэг", "minus": "хасах", "point": "цэг", "percent": "хувь", "year": "оны", "month": "сарын", "hour": "цаг", "minute": "минут",
        "second": "секунд", "degree": "градус", "celsius": "цельсий", "fahrenheit": "фаренгейт", "half": "хагас", "from": "аас", "to": "хүртэл",
    },
    "kz": {
        "zero": "нөл", "minus": "минус", "point": "бүтін", "percent": "пайыз", "year": "жылдың", "month": "айдың", "hour": "сағат", "minute": "минут",
        "second": "секунд", "degree": "градус", "celsius": "цельсий", "fahrenheit": "фаренгейт", "half": "жарты", "from": "ден", "to": "дейін",
    },
}

# Currencies by symbol and by ISO 4217 code; the words are the same in both languages.
CURRENCY_SYMBOLS = {"₮": "төгрөг", "₸": "теңге", "$": "доллар", "€": "евро", "£": "фунт", "¥": "иен", "₽": "рубль"}
CURRENCY_CODES = {"MNT": "төгрөг", "KZT": "теңге", "USD": "доллар", "EUR": "евро", "GBP": "фунт", "JPY": "иен", "CNY": "юань", "RUB": "рубль", "KRW": "вон"}

# Mathematical symbols, in the order of replacement.
MATH_SYMBOLS = {
    "mn": {"+": "нэмэх", "×": "үржүүлэх", "÷": "хуваах", "=": "тэнцүү", "≠": "тэнцүү биш", "<": "бага", ">": "их", "≤": "бага буюу тэнцүү", "≥": "их буюу тэнцүү", "±": "нэмэх хасах", "~": "ойролцоогоор"},
    "kz": {"+": "қосу", "×": "көбейту", "÷": "бөлу", "=": "тең", "≠": "тең емес", "<": "кіші", ">": "үлкен", "≤": "кіші немесе тең", "≥": "үлкен немесе тең", "±": "плюс минус", "~": "шамамен"},
}

# Alphabets, punctuation and the replacements of typographic marks.
MN_LETTERS = "абвгдеёжзийклмноөпрстуүфхцчшщъыьэюя"
KZ_LETTERS = "әғқңұһі"
MARKS = " .,!?-:;\"'()"
MARKS_FROM, MARKS_TO = "–—«»“”‘„", "--\"\"\"\"'\""
ELLIPSIS = ("…", "...")

# Abbreviations in the order of expansion, and units that are expanded after a digit only.
ABBREVIATIONS = {
    "mn": {"г.": "оны", "км": "километр", "см": "сантиметр", "кг": "килограмм", "мл": "миллилитр", "т.": "товч", "тов.": "товч", "ж.": "жил", "сар.": "сар", "өд.": "өдөр", "мин.": "минут", "сек.": "секунд", "цаг.": "цаг"},
    "kz": {"ж.": "жыл", "км": "километр", "см": "сантиметр", "кг": "килограмм", "мл": "миллилитр", "мин.": "минут", "сек.": "секунд", "сағ.": "сағат"},
}
UNITS = {"м": "метр", "г": "грамм", "л": "литр"}

# Special tokens by id; the letters and marks follow them.
SPECIALS = "<PAD> <BOS> <EOS> <UNK> [LANG_MN] [LANG_KZ] [FEMALE] [MALE] [YOUNG] [MIDDLE] [ELDERLY]".split()
VOCABULARY = [*SPECIALS, *MN_LETTERS, *KZ_LETTERS, *MARKS]
PAD, UNK = 0, 3
LANG_TAGS = {"mn": "[LANG_MN]", "kz": "[LANG_KZ]"}

# Speaker metadata that becomes attribute tokens, and values that mean none.
GENDER_TOKENS = {"[FEMALE]": "female f woman women girl".split(), "[MALE]": "male m man men boy".split()}
AGE_TOKENS = {
    "[YOUNG]": "child teen teens twenties 20s young".split(),
    "[MIDDLE]": "adult thirties forties fourties fifties 30s 40s 50s middle".split(),
    "[ELDERLY]": "sixties seventies eighties nineties 60s 70s 80s 90s elderly senior".split(),
}
NO_METADATA = ("none", "null", "nan", "other", "unknown", "")

# Fixed value: the error for a language that isn't supported.
UNSUPPORTED = ("Unsupported language '", "'. Expected one of: kz, mn")

# Text columns in order of preference.
TEXT_COLUMNS = ("sentence_norm", "text", "sentence", "transcript", "transcription")
