"""Word lists for the abuse features, in English, Italian and German. Entries are stems: a word counts if it begins with one.

They are general vocabulary; what else marks abuse in a corpus is learned from its judged documents (see abuse.py).
"""

from __future__ import annotations

#: Nouns thrown at people.
INSULT = ("idiot imbecil moron cretin asshole arsehole dumbass dumbfuck dipshit jackass scumbag prick bastard halfwit dimwit nitwit wanker twat "
          "bitch cunt dickhead douche retard shithead motherfuck bullshitter loser lowlife whore slut faggot cocksucker scum clown fool pig "
          "imbecill stronz coglion deficient scem stupid pezz pagliacc buffon incapac troi puttan testadicazzo "
          "vollidiot arschloch drecksack drecksau dummkopf trottel depp schwachkopf mistkerl miststück hurensohn wichser penner vollpfosten abschaum").split()  # fmt: skip

#: Adjectives and curses that sharpen an insult.
SHARP = ("stupid useless pathetic worthless disgusting braindead brainless insufferable goddamn damn fucking fuck shut shit crap ugly "
         "miserable incompetent maledett dannat inutil schifos patetic vergogn verdammt nutzlos erbärmlich widerlich dumm hirnlos schnauze").split()  # fmt: skip

#: Harm done, wished or threatened.
HARM = ("kill die rot choke hurt beat strangle burn drown hang shoot stab bleed murder smash slap crush punch grave hell deserve regret disappear vanish "
        "sparisc crepa muori ammazz uccid pagherai vaffancul verschwind krepier verreck stirb bereuen umbring").split()  # fmt: skip

#: Sexual words.
SEXUAL = ("nude naked porn horny sexy tits boobs cock dick penis pussy moan undress lick bang thigh slut fuck orgasm blowjob masturbat sex "
          "nuda nudo scop tett sesso porc nackt titten fick geil brüste sexuell ausziehen schenkel").split()  # fmt: skip

#: Groups of people.
GROUP = ("women woman men girls immigrant migrant foreigner jew muslim christian black white gay lesbian trans disabled old elderly refugee gypsy people religion race "
         "donne immigrat stranier ebre musulman negr disabil vecch zingar rom frauen ausländer juden moslem schwul behindert flüchtling alte zigeuner").split()  # fmt: skip

#: Contempt for a group.
SHUN = ("vermin parasit disease plague breed subhuman savage animals inferior filth infest deport exterminat wipe rats "
        "besti parassit feccia ungeziefer untermensch").split()  # fmt: skip

#: Words that only begin like an entry.
GREETING = {"hello", "hallo", "analysis", "also"}

SECOND = set("you your yours yourself yourselves u ur ya tu ti te tuo tua tue tuoi vi voi vostro vostra sei du dich dir dein deine deinen deinem deiner euch euer eure ihr".split())
SELF = set("i me my mine myself io mi mio mia ich mich mir mein meine meinen".split())
THIRD = set("they them their those he him she her who loro lui lei quei quelli questi sie ihnen ihre jene diese welcher che".split())
#: Words that point at a group, whatever its name: what follows them, beside contempt, may be one.
POINTING = set("those these quei quelli quegli quelle diese jene solche".split())
#: Endings of names of peoples, in English.
DEMONYM = ("ish", "ese", "ian", "ians", "ans", "ites")
#: Talk about words, rules and code.
META = set("word words term filter test tests mask masked masks moderator moderators report reported column label flag example sample parola termine filtro wort begriff process processo parent child master slave pointer pointers build hack cache node nodes code".split())

#: Letters and signs that stand for others.
LOOKALIKE = {"@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "!": "i", "|": "l", "а": "a", "е": "e", "о": "o", "р": "p",
             "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n", "ν": "v", "ο": "o", "α": "a", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h"}
