"""Fixed values that results depend on."""

# Spanish stop words of questions.
STOP_WORDS = (
    "a", "al", "algo", "algunas", "algunos", "ante", "antes", "asi", "aun",
    "aunque", "bajo", "bien", "cada", "casi", "como", "con", "contra", "cual",
    "cuando", "de", "del", "desde", "donde", "dos", "durante", "e", "el", "ella",
    "ellas", "ello", "ellos", "en", "entre", "era", "eramos", "eran", "es", "esa",
    "esas", "ese", "eso", "esos", "esta", "estaba", "estaban", "estado", "estamos",
    "estan", "estar", "este", "esto", "estos", "fue", "fueron", "ha", "hace", "hacen",
    "hacer", "hacia", "han", "hasta", "hay", "la", "las", "le", "les", "lo", "los",
    "mas", "me", "mi", "mis", "mismo", "mucho", "muy", "no", "nos", "nuestra",
    "nuestro", "o", "otra", "otras", "otro", "otros", "para", "pero", "poco", "por",
    "porque", "que", "quien", "se", "sea", "segun", "ser", "si", "sin", "sobre",
    "son", "su", "sus", "tambien", "te", "tiene", "tienen", "todo", "todos", "tras",
    "tu", "tus", "un", "una", "unas", "uno", "unos", "y", "ya",
)

# Cues of a question that leans on the conversation, in folded text.
FOLLOW_UP = r"\b(eso|esa|ese|esto|esta|este|esos|esas|estos|estas|otro|otra|otros|otras|mismo|misma|mismos|mismas|anterior|anteriores|diferencia|diferencias|comparar|comparacion|relacion|relaciona|relacionar|vincula|vincular|significa|significado|quiere decir|implica|implicar|funciona|funcionar|depende|depender|aplica|aplicar|y entonces|en ese caso|por que|como se conecta|como se relaciona|que tiene que ver)\b"

# Signs of confusion in folded text; the first as one pattern, the second as substrings.
CONFUSION = r"\b(no entiendo|no entiend(o|e)|no me queda claro|no comprendo|no comprendi|no logro entender|me confunde|estoy confundido|que significa|no se si|no entiendo por que|por que es que|entonces.*es|es lo mismo|seria lo mismo)\b"
CONFUSION_PARTS = ("no entend", "no comprend", "no se", "que significa", "me confund", "me perdi", "no se si", "estoy confund", "es lo mismo", "cual es la diferencia", "no me queda claro", "no queda claro", "no entiendo bien")

# Weights of the fields of an item, and bonuses.
FIELD_WEIGHTS = {"title": 5.2, "keywords": 4.6, "summary": 2.7, "content": 1.15, "source": 0.45}
TITLE_PHRASE, CONTENT_PHRASE, ALIAS, COVERAGE = 10.0, 4.0, 6.0, 5.0
CONTEXT_SHARE, MOST_ALTERNATIVE = 0.22, 0.7
PRIORITY = {"central": 1.5, "context": -1.5}

# Roles of sections by the start of their folded titles.
ROLE_TITLES = (
    ("preliminares", r"^(portada|caratula|front matter|title page|creditos|copyright|derechos de autor|dedicatoria|agradecimientos|colofon|colophon)\b"),
    ("indice", r"^(indice|tabla de contenidos|tabla de contenido|sumario|contents|table of contents|toc|indice analitico|indice onomastico|index|indexes|onomastic index)\b"),
    ("referencias", r"^(bibliografia|bibliography|referencias|references|obras citadas|works cited|citas bibliograficas|filmografia|filmography|fuentes citadas)\b"),
    ("anexo", r"^(anexo|anexos|apendice|apendices|appendix|appendices|glosario|glossary|material suplementario|supplementary material)\b"),
    ("actividades", r"^(actividades|actividad|ejercicios|consignas|preguntas de repaso|review questions|exercises|practice activities|practica)\b"),
)
CONTENT_TITLE = r"^(introduccion|introduction|conclusion|conclusiones|concluding remarks|discusion|discussion|metodo|method|metodologia|methodology|resultados|results|resumen|abstract)\b"
ROLE_SCOPES = {"contenido": "included", "preliminares": "excluded", "indice": "excluded", "referencias": "excluded", "anexo": "reference", "actividades": "reference"}

# Short words that aren't fragments of broken words.
FUNCTION_WORDS = tuple(
    "a al algo ante asi aun bajo cada como con cual cuando cuyo de del desde donde dos e el ella ellas ellos en era eramos eran es esa esas ese eso esta este esto estos fue fueron ha hace han hasta hay la las le les lo los mas me mi mis muy ni no nos o otra otras otro otros para pero por porque que quien se sea segun ser si sin sobre son su sus tambien te todo todos tras tu un una unos uno unas y ya and the for from into not that this with when where which who you your are was were been have has had but can did its our out use".split()
)

# Labels.
MODE_LABELS = {"consulta": "Consulta", "analisis": "Análisis", "socratico": "Socrático", "ocultadores": "Paso a paso"}
CONFUSION_LABELS = ("Sin indicio", "Posible", "Reiterada")
USAGE_LEVELS = ("🔴 Sin uso", "🟡 Inicial", "🟠 Dificultad", "🟢 Activo", "⭐ Avanzado")

# Words that name a kind of document, and words of lines that name no author.
DOCUMENT_TYPES = (("compilacion", "compilacion|antologia|anthology|selected papers|actas"), ("articulo", "articulo|article|academic paper|journal"), ("libro", "libro|monografia|book"))
NO_AUTHOR = "universidad|facultad|department|departamento|instituto|resumen|abstract|keywords"
