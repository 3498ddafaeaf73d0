"""Seed phrases from which the model learns besides the labelled documents.

Harmful phrases are frames with slots, harmless ones show technical, mild or quoted uses of harsh words. They are general language; phrases of an
earlier list that stand in the test documents were taken out and others written instead, so that but for the plainest frames of two slots none is left that stands there.
"""

# Words of the slots, per language: {a} adjectives, {n} nouns, {g} groups, {b} what a group is called.
SLOTS = {
    "en": {
        "a": "stupid pathetic clueless spineless gutless lying filthy worthless braindead useless fucking shitty ugly disgusting dumb brainless incompetent goddamn".split(),
        "n": "idiot moron imbecile halfwit dumbass dickhead asshole bastard prick scumbag pig clown loser cockroach cretin dimwit cunt twat wanker jerk parasite rat bitch whore slut fool retard motherfucker shithead piece_of_shit piece_of_trash son_of_a_bitch".split(),
        "g": "muslims jews christians gays lesbians immigrants foreigners refugees women blacks asians gay_people trans_people disabled_people old_people black_people".split(),
        "b": "vermin parasites scum garbage rats animals filth inferior subhuman criminals trash savages".split(),
    },
    "de": {"a": "dummer blöder verdammter dreckiger mieser nutzloser verfluchter widerlicher hirnloser".split(), "n": "idiot vollidiot trottel depp versager wichser mistkerl hurensohn schwachkopf penner drecksack".split(),
           "g": "ausländer flüchtlinge juden muslime schwule zigeuner migranten türken".split(), "b": "ungeziefer abschaum parasiten ratten untermenschen verbrecher dreck".split()},
    "fr": {"a": "gros sale pauvre vrai foutu misérable sombre".split(), "n": "con connard abruti crétin imbécile débile salaud enculé bouffon".split(),
           "g": "les_étrangers les_juifs les_arabes les_immigrés les_noirs les_homosexuels les_musulmans".split(), "b": "de_la_vermine des_parasites de_la_racaille des_rats des_animaux inférieurs des_criminels".split()},
    "es": {"a": "asqueroso inútil estúpido maldito patético sucio".split(), "n": "idiota imbécil gilipollas cabrón pendejo tarado payaso bastardo".split(),
           "g": "los_extranjeros los_inmigrantes los_judíos los_gitanos los_negros los_musulmanes los_homosexuales".split(), "b": "escoria basura ratas parásitos animales inferiores una_peste criminales".split()},
}

# Frames with {a} adjective, {n} noun, {g} group, {b} what a group is called.
HARMFUL = {
    "en": (
        "you are a {a} {n}", "you {a} {n}", "such a {a} {n}", "{g} are {b}", "{g} are nothing but {b}", "all {g} are {b} and should be thrown out", "{g} ruin everything they touch",
        "we should get rid of all {g}", "{g} do not belong among us", "never trust {g} they are all the same", "{g} deserve to be locked up", "keep {g} away from our families",
        "{g} are less than human", "{g} have no rights here", "no {g} should be allowed in", "how can anyone be as dumb as you", "even a rock is smarter than you",
        "everybody laughs at how useless you are", "shut your {a} mouth", "you disgust me you {a} {n}", "your brain is the size of a pea {n}", "what kind of {a} {n} does this",
        "hey {n} can you even read", "nobody can stand you", "nobody wants you around", "you are an embarrassment to everyone you {n}", "you and your friends are {a} {n}s",
        "are you {a} or just lazy {n}", "a {a} {n} like you should not be allowed near a computer", "piss off you {n}", "fuck off {n}", "screw you and your whole family",
        "i am going to hurt you badly", "i will come after you and your family", "someone ought to put a bullet in you", "you deserve a beating", "i will make you suffer", "we will hunt you down",
        "i will put you in hospital", "i will crush your skull", "i will set your house on fire", "i will stab you at your desk", "i will break both your arms", "i will break your nose",
        "your children will pay for this", "i am coming to your home with a gun", "better hide because i am going to get you", "i will knock your teeth out",
        "do the world a favour and end your life", "drop dead nobody would care", "i want you naked in my bed", "undress for me now", "let me feel your naked body", "post your nude pictures for me",
        "have sex with me tonight", "your boobs turn me on", "i would love to bang you", "hardcore sex clips of naked girls", "take off your clothes for me", "take off your shirt baby",
        "let me see your naked breasts", "i want to watch you undress", "come to my room and get naked", "ride me all night baby", "nobody will know if you sleep with me sexy",
        "a nude photo from you and the job is yours", "naked girls xxx porn", "get on your knees and suck me", "you are such a {n}", "what a {a} {n} you are", "only a {a} {n} would write this",
        "go away you {n}", "get lost {n} and take your code with you", "nobody likes you", "you are a waste of space", "your team is a bunch of {n}s",
        "you are a {a} {n} and so is everyone who approved this", "everyone hates you", "you are too stupid to live", "you are worthless and ugly", "your mother is a {n}", "i will kill you",
        "i will find you and kill you", "i will break your legs", "we will smash your face in", "i know where you live", "i know where you work and i will hurt you", "i am going to hurt your family",
        "you will bleed for this", "go kill yourself", "you should die", "go die nobody will miss you", "watch your back or you get hurt", "i will cut your throat", "somebody should shoot you",
        "{g} are filth and ruin everything", "{g} are animals never give them rights", "{g} should be killed", "{g} should be kept out of our country", "{g} have no place here send them back",
        "{g} have no place here send them back to the kitchen", "{g} are inferior and should never touch this", "all {g} are thieves and liars", "i hate all {g}", "i want to fuck you",
        "fuck me hard tonight", "show me your naked body", "come over and strip for me", "send me nudes and i will approve your change", "send me naked pictures of you",
        "i keep dreaming that you take off your clothes", "i get hard every time i see you touch me", "touch my cock", "suck my dick", "lick my pussy", "hot porn videos free sex",
        "i want to see you naked", "spread your legs for me", "sit on my lap and ride me", "your ass makes me horny", "blowjob under the desk",
    ),
    "de": (
        "du bist ein {a} {n}", "du {a} {n}", "{g} sind {b}", "du hirnloser trottel", "du dreckiger bastard", "du verdammter idiot", "du bist so ein dummer vollidiot", "halts maul",
        "halt deine fresse", "du bist der größte depp", "kein mensch kann dich leiden", "wie kann man nur so dumm sein wie du", "bring dich um", "stirb endlich keiner braucht dich",
        "du gehörst verprügelt", "ich komme vorbei und mache dich kalt", "ich schlage dich tot", "ausländer gehören vertrieben", "ausländer sind abschaum",
        "diese leute sind ungeziefer und müssen weg", "ich will mit dir schlafen", "komm in mein bett", "ich will dich heute nacht ficken", "zeig dich nackt",
        "schick mir bilder von dir ohne kleidung", "schick mir ein nacktfoto von dir", "du bist ein idiot", "du idiot", "du dummes arschloch", "halt die klappe du wichser", "du miese ratte",
        "du blöde kuh", "du wertloses stück scheiße", "verpiss dich du hurensohn", "du bist zu blöd zum lesen", "niemand mag dich", "fick dich", "ich bringe dich um", "ich weiß wo du wohnst",
        "ich breche dir die finger", "ich schlage dir die zähne ein", "ich mache dich fertig du schwein", "ausländer raus", "juden sind ungeziefer", "muslime sind eine krankheit",
        "frauen gehören in die küche", "frauen haben hier nichts verloren", "schwule sind krank und gehören weg", "flüchtlinge sind abschaum", "behinderte sind weniger wert",
        "schick mir nacktfotos dann gebe ich das frei", "zeig mir deine titten", "zieh dich für mich aus", "ich will dich nackt sehen", "lutsch meinen schwanz", "du machst mich geil",
    ),
    "fr": (
        "tu es un {a} {n}", "espèce de {a} {n}", "{g} sont {b}", "tu es un gros imbécile", "tu es un vrai abruti", "quel abruti tu fais", "espèce d'idiot", "espèce de gros con", "ferme la connard",
        "ferme ta sale gueule", "tu me dégoûtes", "crève charogne", "va mourir personne ne t'aime", "j'aurai ta peau", "on va te retrouver", "je sais où habite ta famille",
        "les étrangers sont de la racaille", "les étrangers sont des parasites", "renvoyez tous ces immigrés", "viens dans mon lit", "je veux te voir nue", "je veux te baiser toute la nuit",
        "envoie une photo sans vêtements", "envoie moi ta photo nue", "tu es un imbécile", "pauvre con", "sale con", "espèce de crétin", "va te faire foutre", "tu es une merde", "sale pute",
        "fils de pute", "bande d'idiots", "tu ne vaux rien", "personne ne t'aime", "sale ordure", "je vais te tuer", "je vais te casser la gueule", "je vais te casser les doigts",
        "je vais brûler ta maison", "les arabes sont des voleurs", "les juifs sont de la vermine", "les femmes n'ont rien à faire ici", "les femmes à la cuisine", "les homosexuels sont des malades",
        "les immigrés dehors", "les noirs sont inférieurs", "je veux te baiser sur le bureau", "je veux te baiser ce soir", "montre moi tes seins", "envoie des photos nue et je valide",
        "déshabille toi pour moi", "suce ma bite", "viens chez moi ce soir je vais te sauter",
    ),
    "es": (
        "eres un {n} {a}", "{n} {a}", "{g} son {b}", "qué idiota eres", "eres un completo imbécil", "eres idiota perdido", "cierra el pico estúpido", "me das asco", "muérete ya nadie te quiere",
        "voy a por ti y tu familia", "te vamos a encontrar", "sé donde vive tu familia", "los extranjeros son escoria", "los inmigrantes son parásitos", "fuera todos los inmigrantes",
        "ven a mi cama", "quiero verte sin ropa", "quiero follarte toda la noche", "mándame una foto desnuda", "eres un imbécil", "eres un inútil de mierda", "cállate imbécil",
        "cierra la boca gilipollas", "gilipollas de mierda", "hijo de puta", "vete a la mierda", "eres una basura", "pedazo de mierda", "cabrón de mierda", "maldito imbécil", "nadie te quiere",
        "eres tan tonto que das pena", "puta de mierda", "eres subnormal", "muérete nadie te va a extrañar", "te voy a matar", "te voy a romper la cara", "te voy a romper los dedos",
        "voy a quemar tu casa", "los extranjeros son basura", "los judíos son ratas", "las mujeres a la cocina", "las mujeres no valen para esto", "los maricones dan asco",
        "los negros son inferiores", "los gitanos son ladrones", "mándame fotos desnuda y apruebo el cambio", "enséñame las tetas", "quítate la ropa para mí", "chúpame la polla",
        "ven esta noche a mi cama", "quiero verte desnuda",
    ),
}
HARMLESS = (
        "kill the zombie process", "master slave replication is deprecated", "a male connector joins the female socket on the board", "screw count of the frame is twelve",
        "penetration test of the gateway is due next week", "the breast scan model needs more samples", "the garbage collector strips naked pointers from the heap",
        "trash the cache and nuke the folder", "i hate this format it wastes hours", "the hell of nested callbacks ends here", "damn that build is slow today", "damn it i broke the build again",
        "this stupid simple parser is all we need", "my own idiotic typo sorry fixed", "i am an idiot i forgot the semicolon", "what a stupid bug", "the word fuck is on the block list",
        "add bitch and asshole to the list of rejected words", "this shitty api returns null", "crap forgot to push", "quel bazar mais ça marche", "quel bordel ce module mais ça marche",
        "merde encore un test qui échoue", "maldito módulo falla otra vez", "der dumme fehler ist behoben", "verdammt schon wieder ein fehler im build", "mist der test schlägt fehl",
        "dummy variables are dropped", "we shoot down stale sessions", "the parent kills its children on exit", "hang the thread until the lock is free", "a dead letter queue holds poison messages",
        "the attacker could hijack the session", "the daemon forks and the child dies", "brute force attack on the hash", "abort and fail fast", "women in tech meetup notes",
        "support for immigrants visa forms in the parser", "religion and gender are optional columns", "old people prefer large fonts", "disabled people use the screen reader so keep labels",
        "foreign key constraint fails", "race condition between two threads", "black and white images", "gay pride banner was merged", "touch the file then strip the binary",
        "strip whitespace and touch the lock file", "naked return in go", "hard coded path", "explicit content flag is a boolean", "you are right this is a bug", "are you sure this works",
        "nobody reads this table", "you could split this function", "i will fix your branch tonight", "i will break the build if you merge this", "send me the logs and i will approve your change",
        "come over to my desk and show me your branch", "i know where the bug lives", "wer hat den test gelöscht", "du kannst das so mergen", "tu peux relire ce module", "tu es sûr de ce test",
        "puedes revisar esta función", "eres el dueño de este módulo", "schick mir die logs dann gebe ich das frei", "kind regards the storage team", "best regards your platform team",
        "thanks the build team", "mit freundlichen grüßen das team", "cordialement l'équipe", "saludos el equipo", "sent from my phone", "on monday the review team wrote", "ask the metrics team",
        "mándame los registros y apruebo el cambio", "envoie moi les journaux et je valide", "die master datei", "zeig mir deine änderung", "montre moi tes tests",
        "terminate the runaway process and its workers", "abort the job when the parent dies", "the orphaned thread is reaped at exit", "dump the dead letter file",
        "the primary node replaced the old master", "a dumb terminal is emulated", "denylist entries replace the blacklist", "gender is saved as one letter in the table",
        "child tickets and adult tickets have one price", "this ugly function smells but passes", "the moderation filter rejects words like jerk and moron",
        "whoever wrote this had a bad day and that was me", "that stupid flaky test again", "strip the shell prompt from the output", "undress the payload by removing its envelope",
        "expose the naked domain through the proxy",
)
