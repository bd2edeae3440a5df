"""Word lists of the transcript operators."""

# Spanish words that cannot end a sentence.
INCOMPLETE_ENDINGS = (
    "en el la los las un una unos unas de del que y e o u pero porque para con a por como es son al se su sus mi mis tu tus "
    "este esta estos estas ese esa esos esas aquel"
).split()

# Spanish, then English words that hold a sentence together.
FUNCTION_WORDS = (
    "de la el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta son entre está "
    "cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos "
    "e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella estar estas "
    "algunas algo nosotros mi mis tú te ti tu tus ellas nosotras vosostros vosotras es fue ha han hemos he son sea que "
    "the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she or an will my "
    "one all would there their what so up out if about who get which go me when make can like time no just him"
).split()

# Spanish, then English words without content of their own.
STOP_WORDS = (
    "el la los las un una unos unas de del en para por con se ha han que y o a al su sus este esta estos estas pero cuando donde "
    "porque sobre entre desde hasta hacia todo toda todos todas otro otra otros otras tanto tanta mucho mucha muchos muchas poco "
    "poca cada mismo misma tambien también solo sólo ellos ellas nosotros ustedes haber habia había tiene tienen tener hacer hecho "
    "sido están estamos esto esos esas aquel aquello quienes quien cual cuales cuál cuáles comentado explicado acordado indicado "
    "expuesto reunión tramo sesión sesion punto tema parte "
    "the and that this with for from have they what your were some then there their will would could should just very about into "
    "when more also been each which time them than only other discussed explained mentioned meeting section today here"
).split()

# What speech recognition writes over silence.
HALLUCINATIONS = (
    "subtítulos realizados",
    "subtitulos realizados",
    "comunidad de amara.org",
    "gracias por ver el video",
    "gracias por ver este video",
    "gracias por ver",
    "thank you for watching",
    "suscríbete al canal",
    "suscribete al canal",
    "suscríbete",
    "suscribete",
    "subtitles by",
)

# Impersonal beginnings of card sentences.
PREAMBLES = (
    "se ha comentado que ",
    "se ha explicado que ",
    "se ha acordado que ",
    "se ha mencionado que ",
    "se ha indicado que ",
    "se ha expuesto que ",
    "se comento que ",
    "se comentó que ",
    "se explico que ",
    "se explicó que ",
    "it was discussed that ",
    "it was explained that ",
    "it was agreed that ",
    "it was mentioned that ",
    "the speaker explained that ",
)

# What stands for speech that could not be recognised.
UNINTELLIGIBLE = "[Ininteligible / pendiente de revisión]"
