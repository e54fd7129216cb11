"""The labelled table of the field: invented lines, filled from patterns by a fixed seed.

`{kind|what it is}` marks a span. In the patterns `#` is a digit, `@name` a name, `@host` a
host, `@tld` an ending, `@word` any word, `@hex` four hexadecimal digits, and `{kind}` one of
that kind's forms. Held-out lines come from phrases, names and hosts that the training lines
do not have: names, hosts and words to learn from are drawn from syllables, so that no one of
them is learned. Persons and numbers are made up; some lines without spans copy the look of the
supplied corpus (syllable words, keys, tables), so the measure says nothing of other corpora.
"""

from __future__ import annotations

import re
from random import Random

#: How the rules' kinds are written where the rules do not see them.
FORMS = {
    "email": ("@name dot @name at @host dot @tld", "@name.@name (at) @host.@tld", "@name[at]@host[dot]@tld", "@name (at) @host (dot) @tld",
              "@name[at]@host.@tld", "@name at @host dot @tld", "@name_@name@localhost", "@name [at] @host [dot] @tld", "@name at @host.@tld",
              "@name(at)@host.@tld", "@name AT @host DOT @tld", "@name## (at) @host.@tld"),
    "ip": ("2001:db8:0:0:@hex:@hex:@hex:#", "fe80:0:0:0:@hex:@hex:@hex:@hex", "2001:db8:@hex::@hex", "fe80::@hex:@hex:@hex:@hex", "2001:db8::#",
           "2a0#:@hex:@hex:@hex:@hex:@hex:@hex:@hex", "1##[.]1##[.]##[.]#", "fd00:@hex::#"),
    "phone": ("(###) ###-####", "###-###-####", "###.###.####", "### ### ####", "(###)###-####", "0## #### ####", "0#### ######", "0### ########",
              "1-###-###-####", "0##/######", "0## ### ## ##", "0# ## ## ## ##", "00## ### #######", "(0##) ########"),
    "card": ("4### #### #### ####", "5###-####-####-####", "5###.####.####.####", "37## ###### #####", "6### #### #### ####", "3###.####.####.####"),
}
#: Forms that are one number without marks: a kind only where the words before say so.
BARE = {"phone": ("##########", "0##########", "###-####"), "card": ("################", "4###############", "37#############", "4############"), "email": (), "ip": ()}
#: What is no kind, in any surroundings.
PLAIN = ("################", "4###############", "6###############", "5###############", "3###############", "###############", "#############", "##########",
         "0#########", "#######", "####", "20##", "#.#.#", "##-##", "#### ####", "### ### ###", "(###)", "@word.@word", "@word:@word::@word")

PHRASES = {
    "email": ("please write to {email} before noon", "mail me : {email} thanks", "contact {email} or ask at the desk", "send it to {email} please",
              "reach {email} for the key", "email {email} today", "my address is {email} , write soon", "E-Mail : {email}", "mail: {email}.",
              "@word @word {email} @word", "{email}", "@name or {email} at last", "{email} at @word or @word", "\"email\":\"{email}\",\"@word\":#", "correo : {email} , gracias"),
    "ip": ("the server {ip} did not answer", "ping {ip} from the lab", "host {ip} is down", "ip {ip} , port ####", "from {ip} at ##:##:##",
           "@word @word {ip} @word @word", "address={ip};", "{ip}", "\"ip\":\"{ip}\"", "the packet left {ip}."),
    "phone": ("call {phone} after five", "phone {phone} for a table", "tel {phone} or come by", "phone : {phone} at any time", "call me on {phone} tonight",
              "Tel.: {phone} in the morning", "fax {phone} to the office", "mobile {phone} works too", "@word @word {phone} @word @word",
              "the number is {phone}", "{phone}", "\"phone\":\"{phone}\"", "you can call us any day at {phone}.", "ring {phone}, {phone} or come",
              "telefon {phone} , bitte", "my number : {phone} !"),
    "card": ("card number {card} was refused", "my card is {card} until may", "credit card {card} expired", "visa {card} please", "card no {card} is lost",
             "pay by card : {card} , thanks", "\"card\":\"{card}\"", "card={card};", "mastercard {card}, exp ##/##", "the card {card} of @word",
             "karte {card} ist weg", "charged to {card} on the card"),
}
#: Phrases only bare numbers go into; each has a word that says what the number is.
CUED = {"phone": ("call {phone} now", "phone : {phone}", "tel {phone} today", "mobile {phone} works", "my phone number is {phone}"),
        "card": ("card {card} was refused", "visa {card} please", "credit card : {card} , thanks", "the card number is {card}"), "email": (), "ip": ()}

NOTHING = (
    "they met at noon at the house and sat at the table", "look at the dot com boom of that time", "he stood at @host one and went on",
    "we stayed at @host for a while , then at @word", "@name at @host said so", "meet @name at @host.", "the dot at the end of a line",
    "version #.#.# is out , see section #.# and #.#.#", "it was ##:## on 20##-0#-1# when they left", "at ##:##:## the clock stopped and at ##:## it went on",
    "the number ################ is not prime", "of ################ rows it kept ################ in the end", "order ###-### came on page ### of ####",
    "id ################# of the list and ########## of the other", "in 19## there were ### of them and in 20## some #,###", "id : ##########",
    "the year 20## 20## 20## saw ### ### people", "20## 20## 20## 20##", "19## 19## 20## , 20## 20## 20## 20## 20##", "@word ########## @word @word ###########",
    "1 2 3 4 5 6 7 8 9 10", "## ## ## ## ## ##", "### ### ### ### ###", "#### #### #### #### #### ####", "# # # #", "### ### ###", "#### ####", "## ### ####", "#### ### ##",
    "it costs ##.## or #,###.## with all parts", "### ### ### rows and ## ### of them", "a total of # ### ### ### bytes", "@word ### ### @word",
    "licensed under CC BY-NC 4.0 and Apache License , Version 2.0", "the terms of the General Public License , version 3.", "isbn 978-#-##-######-#", "ISBN 978-3-##-######-#",
    "key AKIAMD##HKU#VBLCCCCE was found and AKIAPTDW#XUFB##SMKLH too", "token = \"0641917ea4e9feb9cda83477b57ac2654884f485\" in the file",
    "password=b7db7aa4a5fcc78305 in the log of the day", "sha e3b3ed3cc8548923d6 and c1f6c02f845bf3028d of the commit", "mac 00:1a:2b:3c:4d:5e of the card",
    "part ###-#### of the series and model ###-A of that year", "rooms (##) and (###) on floor # are free", "use std::map and a::b of the module", "dead::beef and face::add are names",
    "we call this the rule of # and phone makers the rule of ##", "call # of them or ## , the card of ## and the visa of 20##", "call it a day", "a phone , a card and a mail",
    "the score was #-# and ###-## in the end", "chapter ## , verse # : see #.# and #.#.#", "on ##/0#/20## and #/# of the way to ##%", "the phone costs ###.## and the card ##",
    "a # b ## c ### d #### e ##### f ###### g #######", "| ## | ### | #### | ##### | ##.# | 0.## |", "iban DE## #### #### #### #### ##", "x = [##, ###, ####, #####]",
    "the the of and to in a is that it for on was with as be by at from", "die der und in den von zu das mit sich des auf ist im dem nicht",
    "le la les de des et en un une est que dans pour qui sur au pas", "el la los de que y en un una es por con para se del las su al",
    "And So It Goes On Until The End Of The Day", "ALL OF THIS IS LOUD !! AND THIS !! TOO !!", "lat ##.###### , lon #.######", "2#####.##### -##.#####",
    "the end.then came an.other one and so.on and on.and it.was all er.hodn thantion.arg", "see file.txt and readme.md or main.py in src.old of that disk",
    "word.word word.word word.word a.b c.d now.then here.there", "so he said.And then on.To the end of it.all", "at @host.@tld you find more", "he is at @host.@tld now", "the dot and the at sign", "a dot at the top", "@word dot @word , dot by dot",
    "at this time of the day at home and at work at most at last", "see www.example.com/a/b?c=1 and http://example.org/x.html for that",
    "x@y and a @ b are no address , nor is @home or 5 @ 3", "@word @word @word @word @word @word", "20##-0#-## ##:##:## INFO @word started", "build 20##0### of ##########",
    "0#.0#.20## - 1#.1#.20##", "1. @word 2. @word 3. @word", "phone ## of ### in list ####", "the call of 19## and the card of 20##",
)
#: Phrases and fillings that only the held-out lines have.
HELD_PHRASES = {
    "email": ("questions go to {email} this week", "if lost , mail {email} at once", "the editor ( {email} ) will reply", "ask @word : {email}", "<a>{email}</a>", "<li>{email} or so", "send a note : {email} ; @word"),
    "ip": ("a request from {ip} was dropped", "route add {ip} via eth0", "remote={ip}, state=open", "she saw {ip} in the log"),
    "phone": ("for help dial {phone} on weekdays", "office : {phone} , floor #", "reach us by phone on {phone}.", "@word ; {phone} ; @word", "her mobile number , {phone} , is new"),
    "card": ("he paid with his visa card {card} there", "refund to card {card} , please", "\"credit_card\": \"{card}\", \"x\": #", "stolen card : {card}"),
}
HELD_NOTHING = (
    "the meeting at @host was on 20##-0#-##", "from 19## to 20## , ### to ### a year", "see table #.## and pages ###-### of volume ##", "weights ##.# ##.# ##.# ##.#",
    "#### of #### files , #### ok", "it took ## min ## sec", "he came first at @word in 19## and 20##", "0x####### and 0b##", "serial ############ of @word",
    "the list 20## 20## 20## ends", "### ### ### ### ### ### ###", "@word at @word , @word at @word", "we call @word by its name ## times", "sum ## ### ### of ### ###",
    "ns::type and ::x of c++", "the lot ###-##-### was sold", "@word @word 4############### @word", "the sum is 5############### in all", "pin the post on the wall at # pm", "12:##:## [ERROR] code ####", "@word.@word (@word) @word",
)
HELD_WORDS = {
    "name": ("eva", "peter", "help", "novak", "ruth", "kim", "anna", "joe", "smith", "sales"),
    "host": ("northwind", "sample", "riverbank", "example", "mailbox"),
    "word": ("house", "Thanstat", "et", "river", "thhing", "und", "menten", "of", "ereant", "para", "blue", "was", "Then", "stone", "it"),
}
TLDS = ("com", "org", "net", "de", "fr", "es", "io", "edu")
#: Around each kind, whatever the words are.
ANYWHERE = ("@word @word {} @word @word", "@word {}", "{} @word", "@word : {} , @word", "( {} )", "<@word>{}</@word>", "<a>{}</a>", "<p>{}</p>", "<td>{}</td> <td>{}</td>", "of : {}", "in the {} of the @word",
            "@word to {} at @word ##", "@word, {}, @word", "is {} in the", "@word ( {} ) @word", "the {} and @word")


def _word(rng: Random) -> str:
    made = "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) + rng.choice(("", "n", "r", "s"))
    return made.capitalize() if rng.random() < 0.2 else made


def _fill(line: str, held: bool, rng: Random) -> str:
    def said(m: re.Match) -> str:
        if m[1] == "tld":
            return rng.choice(TLDS)
        return rng.choice(HELD_WORDS[m[1]]) if held else _word(rng)

    line = re.sub(r"@hex", lambda _: f"{rng.randrange(4096, 65536):x}", line)
    line = re.sub(r"@(name|host|tld|word)", said, line)
    return re.sub(r"#", lambda _: rng.choice("0123456789"), line.replace("1##[.]1##", f"1{rng.randrange(10, 99)}[.]1{rng.randrange(10, 99)}"))


def lines(held: bool = False, a_phrase: int = 8, seed: int = 6) -> list[str]:
    """The lines to learn from, or the held-out ones: every phrase filled `a_phrase` times."""
    rng = Random(seed + held)
    out = []
    for kind, phrases in (HELD_PHRASES if held else PHRASES).items():
        general = () if held else [x.replace("{}", f"{{{kind}}}") for x in ANYWHERE]
        for phrase in (*phrases, *general):
            out += [re.sub(r"\{(\w+)\}", lambda m: f"{{{m[1]}|{rng.choice(FORMS[m[1]])}}}", phrase) for _ in range(a_phrase)]
        for phrase in () if held else CUED[kind]:
            out += [phrase.replace(f"{{{kind}}}", f"{{{kind}|{rng.choice(BARE[kind])}}}") for _ in range(a_phrase)]
    for phrase in () if held else ANYWHERE:
        out += [phrase.replace("{}", plain) for plain in PLAIN]
    for phrase in HELD_NOTHING if held else NOTHING:
        out += [phrase] * max(1, a_phrase // 2)
    if not held:  # two in three stand among other words
        out = [line if n % 3 == 0 else "@word " * rng.randint(1, 4) + line + " @word" * rng.randint(1, 4) for n, line in enumerate(out)]
    return [_fill(line, held, rng) for line in out]


def parted(line: str) -> tuple[str, list[tuple[str, int, int]]]:
    """A line's text and its spans (kind, start, end)."""
    text, spans = "", []
    for n, part in enumerate(re.split(r"\{(\w+\|[^}]*)\}", line)):
        kind, _, said = part.partition("|") if n % 2 else ("", "", part)
        if n % 2:
            spans.append((kind, len(text), len(text) + len(said)))
        text += said
    return text, spans
