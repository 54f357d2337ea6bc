"""Word lists, patterns and limits of the Indonesian pack. All of these are fixed values: results depend on each of them."""

from __future__ import annotations

# Informal abbreviations and what they stand for.
SLANG = {
    "yg": "yang", "dgn": "dengan", "dg": "dengan", "krn": "karena", "krna": "karena", "utk": "untuk", "dlm": "dalam",
    "thd": "terhadap", "thdp": "terhadap", "pd": "pada", "dr": "dari", "sbg": "sebagai", "spt": "seperti", "spy": "supaya",
    "stlh": "setelah", "sblm": "sebelum", "sdh": "sudah", "blm": "belum", "jg": "juga", "lg": "lagi", "lbh": "lebih",
    "krg": "kurang", "kpd": "kepada", "tsb": "tersebut", "dpt": "dapat", "bs": "bisa", "ttg": "tentang", "mjd": "menjadi",
    "adl": "adalah", "tdk": "tidak", "hrs": "harus", "sm": "sama", "byk": "banyak", "jml": "jumlah", "jwb": "jawab",
    "prlu": "perlu", "msk": "masuk", "klau": "kalau", "klo": "kalau", "kl": "kalau", "sy": "saya", "mrk": "mereka",
    "mk": "maka", "tnp": "tanpa", "mll": "melalui", "brs": "bersama", "scr": "secara", "trs": "terus", "sll": "selalu",
    "plg": "paling", "dkk": "dan kawan-kawan", "dst": "dan seterusnya", "dsb": "dan sebagainya", "dll": "dan lain-lain",
}
# Ordinals of numbered items, words that continue a line, words of tasks.
ORDINALS = {"1": "Pertama", "2": "Kedua", "3": "Ketiga", "4": "Keempat", "5": "Kelima", "6": "Keenam", "7": "Ketujuh", "8": "Kedelapan", "9": "Kesembilan"}
CONJUNCTIONS = ["dan", "atau", "serta", "yang", "untuk", "dengan", "pada", "ke", "dari", "oleh", "dalam", "ini", "itu", "juga", "namun"]
TASK_WORDS = ["tugas", "latihan", "soal", "buatlah", "presentasikan", "kerjakan", "diskusikan"]
# Keywords of noise units.
NOISE_START = ["kata pengantar", "daftar isi", "daftar pustaka", "daftar gambar", "daftar tabel", "ucapan terima kasih", "prakata", "sanwacana", "persembahan", "daftar singkatan", "lembar pengesahan", "halaman judul", "abstrak"]
GRATITUDE = ["mengucapkan terima kasih", "terima kasih kepada", "rasa syukur", "puji syukur", "alhamdulillah", "segala puji", "rahmat dan hidayah", "karunia-nya", "penyusun mengucapkan", "penulis mengucapkan"]
COVER = ["program studi", "mata kuliah", "disusun oleh", "tim pengampu", "tahun ajaran", "semester genap", "semester ganjil", "universitas", "fakultas", "nim :", "nim:", "nip :", "nip:"]
CONTENT_SKIP = ["kata pengantar", "daftar isi", "isbn", "hak cipta", "cetakan", "diterbitkan", "perancang sampul", "ikapi"]
STRUCTURAL = ["daftar isi", "kata pengantar", "daftar pustaka", "daftar gambar", "daftar tabel", "isbn", "hak cipta", "bagian i", "bagian ii", "bagian iii", "bagian iv", "bagian v", "program studi", "mata kuliah", "disusun oleh", "tim pengampu"]
# Predicates of definitions, and the subset that counts as a bare token.
DEFINERS = ["adalah", "merupakan", "yaitu", "ialah", "didefinisikan sebagai", "dapat diartikan sebagai", "dikenal sebagai"]
BARE_DEFINERS = ["adalah", "merupakan", "yaitu", "ialah"]

# Patterns (Java syntax; S, D stand for Unicode white space and digits where it matters).
LINE_NOISE = [r"^\d+\s*$", r"^[ivxIVX]+\s*$", r"(?i)^\d+\s+Bahan\s+Ajar", r"(?i)Bahan\s+Ajar.*Komputer\s*$"]
TOC_LINE = r"^[A-Za-z0-9\s.\-–]+\s{2,}\d+\s*$|^[A-Za-z0-9\s]+\.*\s+[ivxIVX]+\s*$|^\s*[A-Z]\.\s+.{5,}\s+\d+\s*$"
HEADER = (
    r"^(kata\s+pengantar|daftar\s+isi|daftar\s+pustaka|daftar\s+gambar|daftar\s+tabel|daftar\s+singkatan|prakata|sanwacana|persembahan|halaman\s+judul|"
    r"lembar\s+pengesahan|abstrak|abstract|biodata\s+penulis|tentang\s+penulis|tentang\s+penyusun|profil\s+penulis|riwayat\s+hidup)\s*$"
)
COLOPHON = r"^[A-Z][a-zA-Z\s]+,\s*(19|20)\d{2}\s*$"
PUBLICATION = r"(?i)isbn|hak\s+cipta|copyright|©|diterbitkan\s+oleh|penerbit|cetakan\s+(ke|pertama|kedua)|all\s+rights\s+reserved"
TOC_INLINE = r"(?i)(kata\s+pengantar|daftar\s+isi|daftar\s+pustaka).{0,300}(i{1,4}v?|vi{0,3}|ix|\d{1,3})\s*($|[A-Z])"
BULLET = r"^[•\-*–→●○►]\s+"
NUMBER = r"^(\d+\.\s+|[a-zA-Z]\.\s+)"
NUMBER_ITEM = r"^(\d+)\.\s+(.*)"
COMPLETE = r"[.!?]\s*$"
LIST_START = r"^(\d+\.|[•\-*])"
STRIP_NUMBER = r"^(\d+\.|[a-zA-Z]\.)\s*"
ACRONYM = r"\b([A-Z][A-Z/]{1,5})\b"
# The same with boundaries spelled out: letters, numbers and the underscore of all scripts make words, marks don't.
ACRONYM_ALL = r"(?<![\p{L}\p{N}_])([A-Z][A-Z/]{1,5})(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"
BAD_START = (
    r"(?i)^(bab|gambar|tabel|pertama|kedua|ketiga|keempat|kelima|keenam|ketujuh|kedelapan|berikut|adalah|kemudian|selain|adapun|oleh|"
    r"berikut adalah penjelasan tentang|cara kerjanya|cara kerja|rumus|contoh|misalnya|perhatikan|lihat|amati|pilih|lakukan|"
    r"klik|tekan|ketik|buka|tutup|masuk|keluar|tambah|hapus|ubah|langkah|tahap|proses|prosedur)"
)
DEFINITION = r"(?i)^.{3,80}\s+(adalah|merupakan|yaitu|ialah|didefinisikan\s+sebagai|dapat\s+diartikan\s+sebagai|dikenal\s+sebagai)\s+.{10,}"
CHARACTERISTIC = r"(?i)^.{3,60}\s+(memiliki|berfungsi|digunakan\s+untuk|bertujuan\s+untuk|terdiri\s+(atas|dari)|meliputi|mencakup|menghasilkan)\s+.{10,}"
PROCESS = r"(?i)^.{3,60}\s+(bekerja\s+dengan|dilakukan\s+dengan|diterapkan\s+dengan|dijalankan\s+dengan|diproses\s+(melalui|dengan))\s+.{10,}"
# The three patterns by kind, each with words of which a match holds one at least.
KINDS = {
    "definition": (DEFINITION, ("adalah", "merupakan", "yaitu", "ialah", "didefinisikan", "dapat", "dikenal")),
    "function": (CHARACTERISTIC, ("memiliki", "berfungsi", "digunakan", "bertujuan", "terdiri", "meliputi", "mencakup", "menghasilkan")),
    "process": (PROCESS, ("bekerja", "dilakukan", "diterapkan", "dijalankan", "diproses")),
}
FORMULA = r"[A-Za-z]\s*\([a-zA-Z,\s]+\)\s*[=→←]|[=→←≤≥≠]\s*\d|\b\d+\s*[+\-*/]\s*\d+"
EMOJI_TWICE = r"[\x{1F300}-\x{1FAFF}].*[\x{1F300}-\x{1FAFF}]"
# Word forms that count as the same in questions, in this order.
QUESTION_FORMS = [
    (r"\b(apakah|apakan)\b", "apa"), (r"\b(bagaimanakah)\b", "bagaimana"), (r"\b(mengapakah)\b", "mengapa"), (r"\b(siapakah)\b", "siapa"),
    (r"\b(dimanakah|di\s+manakah)\b", "dimana"), (r"\b(kapankah)\b", "kapan"), (r"\b(berapakah)\b", "berapa"),
    (r"\bdi\s+maksud\b", "dimaksud"), (r"\bdi\s+mana\b", "dimana"), (r"\bdi\s+sini\b", "disini"), (r"\bdi\s+sana\b", "disana"),
]
# Prompt templates by kind, and stand-in options.
TEMPLATES = {
    "definition": ["generate question type: definition answer: {answer} context: {context}", "generate question: answer: {answer} context: {context}", "generate question type: what is answer: {answer} context: {context}"],
    "function": ["generate question type: function answer: {answer} context: {context}", "generate question type: why answer: {answer} context: {context}", "generate question: answer: {answer} context: {context}"],
    "process": ["generate question type: process answer: {answer} context: {context}", "generate question type: how answer: {answer} context: {context}", "generate question: answer: {answer} context: {context}"],
    "general": ["generate question: answer: {answer} context: {context}", "generate question type: why answer: {answer} context: {context}", "generate question type: how answer: {answer} context: {context}", "generate question type: when answer: {answer} context: {context}"],
}
FALLBACK_OPTIONS = ["Semua jawaban di atas benar", "Tidak ada jawaban yang tepat", "Informasi tidak disebutkan"]
# Prompts to a model for the answer and for distractors, the stand-in for an empty question, and how long replies may be.
ANSWER_PROMPT = """Kamu adalah asisten akademik yang membaca dokumen dan menjawab pertanyaan secara tepat.

Konteks dari dokumen:
\"\"\"{context}\"\"\"

Pertanyaan: {question}
Petunjuk topik: {anchor}

Tugas:
Berikan jawaban yang BENAR dan FAKTUAL berdasarkan konteks di atas.
Syarat:
- Maksimal 20 kata
- Berdasarkan isi konteks, bukan pengetahuan umum
- Berbentuk frasa atau kalimat lengkap
- Tidak mengulang kata-kata dari kalimat pertanyaan secara verbatim

Balas HANYA dengan JSON (tanpa penjelasan, tanpa markdown):
{"answer": "jawaban di sini"}"""
DISTRACTOR_PROMPT = """Kamu adalah pembuat soal pilihan ganda Bahasa Indonesia yang ahli.

Konteks dari dokumen:
\"\"\"{context}\"\"\"

Pertanyaan: {question}
Jawaban benar: {correct}

Tugas:
Buat 3 pilihan jawaban yang SALAH tapi MENGECOH.
Syarat setiap distractor:
- Salah secara faktual berdasarkan konteks
- Terdengar masuk akal dan relevan dengan topik
- Panjang mirip jawaban benar (±5 kata)
- Menggunakan kosakata dari konteks yang sama
- JANGAN gunakan kata "bukan", "tidak", atau negasi eksplisit lainnya
- Ketiga distractor harus berbeda satu sama lain

Balas HANYA dengan JSON (tanpa penjelasan, tanpa markdown):
{"distractors": ["distractor1", "distractor2", "distractor3"]}"""
NO_QUESTION = "[tidak dapat di-generate]"
QUESTION_TOKENS, ANSWER_TOKENS, DISTRACTOR_TOKENS = 64, 150, 250
# Sentence frames and limits.
HEADING_FRAME = "Berikut adalah penjelasan tentang "
BULLETS_AFTER_PREFIX, BULLETS_ALONE = " Hal-hal tersebut meliputi: ", "Terdapat beberapa hal, yaitu: "
NOISE_TOC, BLOCK_TOC, CHUNK_TOC = 0.35, 0.40, 0.30
MERGE_WORDS, KEEP_WORDS, PREFIX_WORDS, MAX_LOOKUPS = 30, 6, 12, 20
