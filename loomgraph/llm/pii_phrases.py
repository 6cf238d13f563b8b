"""Sentences with personal information whose parts don't come from this project's tables.

Used for fitting and measuring the tagger only; no query runs this. ``phrase`` makes a
sentence from a template and parts; ``MEASURED`` are whole sentences, written by hand and
never fitted on, with the places that must be found.
"""

from __future__ import annotations

import numpy as np

# Common given and family names, towns and kinds of street.
GIVEN = """James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Thomas Sarah Daniel Karen Matthew Nancy Anthony Lisa Mark Sandra
Paul Ashley Steven Kimberly Andrew Donna Kenneth Carol Joshua Michelle Kevin Amanda Brian Laura Peter Anna Hans Ursula Stefan Monika Jürgen Sabine Lukas Katrin Pierre Camille Jean Sophie
Luc Chloé José Carmen Luis Pilar Javier Lucía Marco Giulia Paolo Chiara Lars Ingrid Sven Astrid Piotr Agnieszka Ivan Olga Dmitri Natalia Wei Mei Hiroshi Yuki Kenji Sakura Min-jun Ji-woo
Raj Anjali Vikram Deepa Ahmed Fatima Omar Layla Kwame Ama Chinedu Ngozi Siobhan Liam Niamh Owen""".split()
FAMILY = """Johnson Williams Brown Jones Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Taylor Moore Jackson Martin Lee Thompson White Harris Clark Lewis
Robinson Walker Young Allen King Wright Scott Hill Green Adams Nelson Baker Hall Campbell Mitchell Carter Roberts Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Schäfer Koch
Dubois Moreau Laurent Lefebvre Rousseau Ruiz Navarro Torres Ortega Rossi Ferrari Bianchi Romano Larsen Hansen Nilsson Kowalski Nowak Ivanov Petrova Volkov Zhang Wang Chen Tanaka Suzuki
Yamamoto Kim Park Choi Sharma Gupta Singh Reddy Khan Hassan Ali Okafor Mensah O'Connor Murphy Kelly Byrne McDonald van Dijk de Vries""".split()
TOWNS = "Springfield Boston Chicago Seattle Denver Austin London Leeds Bristol Glasgow Dublin Toronto Sydney Munich Hamburg Köln Leipzig Dresden Vienna Zürich Lyon Nantes Lille Bordeaux Madrid Sevilla Bilbao Milano Torino Oslo Utrecht".split()
STREETS = "Main Oak Maple Cedar Park Church High Station Mill River Lake Hill Washington Lincoln Elm Pine Victoria Queen King Bridge".split()
KINDS = "Street Avenue Road Lane Drive Court Boulevard St. Ave. Rd. Blvd Close Terrace".split()
GERMAN = "Haupt Bahnhof Garten Schul Berg Linden Kirch Wald Mühlen Goethe Schiller Ring".split()
SPEAKING = "info sales support team jobs hello".split()
DOMAINS = "gmail.com outlook.com yahoo.co.uk example.org web.de orange.fr company.io mail.example.net uni-mainz.de acme-corp.com".split()
ONSETS, VOWELS, CODAS = "b br c ch d dr f g gr h j k kl l m n p pr r s st t tr v w z".split(), "a e i o u ai ea ie oo".split(), "n r l s th ck m nd rt ng".split()
TITLES = "Dr. Prof. Mr. Mrs. Ms. Herr Frau Dr".split()

TEMPLATES = """My name is {p} and my wife is {p}.
Ticket assigned to {p} yesterday.
{t} {p} wohnt in der {a}.
Please contact {p} at {e} or call {f}.
Call me on {f} after six.
phone: {f}, email: {e}
SSN {i} belongs to {p}.
My social security number is {i}.
passport {i} issued to {p}
{p} lives at {a}.
Ship it to {p}, {a}.
Address: {a}
Signed, {p}
Thanks, {p}
cc {e}
{p} wrote: the index is rebuilt every night.
According to {p}, the backup failed.
We met {t} {p} in the office; reach them under {f}.
Meeting notes by {p} and {p}, reviewed by {p}.
Send the invoice to {a} and a copy to {e}.
Customer {p} ({e}, {f}) asked for a refund.
Ich bin {p}, Telefon {f}.
Je m'appelle {p} et j'habite {a}.
Me llamo {p}, mi correo es {e}.
driver's license {i}, name {p}
The report of {p} was sent from {e}.
author: {p} <{e}>
from {e} to {e}
tax id {i}
Emergency contact: {p}, {f}
{p} asked whether the node is still there.
{p} can be reached at {f}.
Yesterday {p} opened a ticket about the {c} cluster.
Reported by {p} on Tuesday.
The parcel goes to {p}, {a}.
For {p} the answer was late.
{p} and {p} merged the branch.
It was {p} who found the error.
Invoice for {p} of {c}
Her number is {f}, her mail {e}.
His id is {i}; keep it secret.
Her SSN is {i}, do not share it.
The meeting with {p} is at ten.
Please forward this to {p} or {p}.
user {p} logged in from {c}
The city of {c} opened a new library at noon.
Version 10.4.2 was released on 2024-06-01 with 1,250 fixes.
Apache Spark and the Knowledge Graph team agreed on the Data Model.
Order 4417-22 holds 12 items at 3.50 each.
In New York the Query Planner and the Index Builder ran on Monday Morning.
GET /api/v1/users/12345 took 312 ms on node-17.
Das neue Release der Graph Datenbank läuft seit Montag in {c}.
The Hidden Markov Model and the Nearest Neighbour Search are described in Chapter Four.""".split("\n")

# Written by hand for measuring; what stands between braces is a place, after its kind.
MEASURED = """My name is {person:John Smith} and my wife is {person:Maria Garcia}.
Ticket assigned to {person:Priya Patel} yesterday.
Herr {person:Müller} wohnt in der {address:Hauptstraße 5, 10115 Berlin}.
{person:Emily Johnson} can be reached at {phone:(415) 555-0132}.
Her SSN is {idnum:123-45-6789}, please keep it safe.
Yesterday {person:Angela Merkel} gave a talk about the index.
Write to {email:ben.foster@northmail.com} for access.
The parcel goes to {person:Grace Hopper}, {address:221 Baker Street, London}.
{person:Carlos Mendoza} and {person:Aisha Bello} reviewed the change.
You can phone {phone:+44 20 7946 0958} from nine to five.
Our office is at {address:1600 Pennsylvania Avenue, Washington}.
Reported by {person:Tomás Herrera} on the third of May.
Contact {person:Yusuf Demir} ({email:y.demir@firma.de}) about the cluster.
Dr. {person:Helen Park} approved the migration plan.
The passport number {idnum:AB1234567} was redacted.
Mail {email:support@helpdesk.example.com} or dial {phone:555-867-5309}.
{person:Noah Baumbach} asked whether the graph is directed.
Send the form to {address:42 Wallaby Way, Sydney}.
The Query Planner uses the Label Index first.
Apache Kafka topics are listed in Section Three.
The backup of 2024-03-05 took 12 minutes and 40 seconds.
New York and San Francisco are labels in this graph.""".split("\n")


def measured() -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, places) of the sentences in ``MEASURED``."""
    out = []
    for line in MEASURED:
        text, spans = "", []
        for i, part in enumerate(line.replace("}", "{").split("{")):
            if i % 2:
                kind, _, value = part.partition(":")
                spans.append((kind, len(text), len(text) + len(value)))
                text += value
            else:
                text += part
        out.append((text, spans))
    return out


def person(r: np.random.Generator) -> str:
    """A name in one of the ways in which names are written, of common parts or of made-up syllables."""
    pick = lambda x: x[int(r.integers(len(x)))]
    made = lambda: "".join(pick(ONSETS) + pick(VOWELS) + (pick(CODAS) if r.random() < 0.6 else "") for _ in range(int(r.integers(1, 4)))).capitalize()
    given = pick(GIVEN) if r.random() < 0.6 else made()
    last = pick(FAMILY) if r.random() < 0.6 else made()
    if len(given) < 3:
        given += "na"
    if len(last) < 3:
        last += "man"
    way = r.random()
    full = f"{last}, {given}" if way < 0.12 else f"{given[0]}. {last}" if way < 0.24 else f"{given} {chr(65 + int(r.integers(26)))}. {last}" if way < 0.34 else f"{given} {last}"
    case = r.random()
    return full.upper() if case < 0.03 else full.lower() if case < 0.035 else full


def _digits(r: np.random.Generator, form: str) -> str:
    return "".join(chr(48 + int(r.integers(10))) if c == "#" else chr(65 + int(r.integers(26))) if c == "@" else c for c in form)


def _part(r: np.random.Generator, kind: str) -> str:
    pick = lambda x: x[int(r.integers(len(x)))]
    if kind == "p":
        return person(r)
    if kind == "t":
        return pick(TITLES)
    if kind == "c":
        return pick(TOWNS)
    if kind == "f":
        return _digits(r, pick(["(###) ###-####", "###-###-####", "+## ## #### ####", "+1 ### ### ####", "+49 ### #######", "0# ## ## ## ##", "0#### ### ###", "+33 # ## ## ## ##", "###.###.####"]))
    if kind == "i":
        return _digits(r, pick(["###-##-####", "@@#######", "@@#######@", "@-####-####-@", "## ## ## ### ##"]))
    if kind == "e":
        given, last = pick(GIVEN).lower(), pick(FAMILY).lower().strip("'")
        local = pick([f"{given}.{last}", f"{given[0]}{last}", f"{given}{int(r.integers(100))}", pick(SPEAKING), f"{given}_{last}"])
        local = "".join(c for c in local if c.isascii() and (c.isalnum() or c in "._-")) or "mail"
        at, dot = (" [at] ", " [dot] ") if r.random() < 0.08 else ("@", ".")
        return f"{local}{at}{pick(DOMAINS).replace('.', dot)}"
    n, town = int(r.integers(1, 999)), pick(TOWNS)
    way = r.random()
    if way < 0.55:
        return f"{n} {pick(STREETS) if r.random() < 0.6 else pick(FAMILY)} {pick(KINDS)}" + (f", {town}" if r.random() < 0.6 else "") + (_digits(r, " #####") if r.random() < 0.2 else "")
    if way < 0.85:
        return f"{pick(GERMAN)}{pick(['straße', 'strasse', 'weg', 'platz'])} {n}" + (f", {_digits(r, '#####')} {town}" if r.random() < 0.6 else "")
    return f"{n} rue de {pick(TOWNS)}" + (f", {_digits(r, '#####')} {town}" if r.random() < 0.6 else "") if way < 0.95 else f"P.O. Box {n}, {town}"


KIND = {"p": "person", "e": "email", "f": "phone", "i": "idnum", "a": "address"}


def phrase(r: np.random.Generator) -> tuple[str, list[tuple[str, int, int]]]:
    """A sentence with its places."""
    out, spans = "", []
    for i, part in enumerate(TEMPLATES[int(r.integers(len(TEMPLATES)))].replace("}", "{").split("{")):
        if i % 2:
            value = _part(r, part)
            if part in KIND:
                spans.append((KIND[part], len(out), len(out) + len(value)))
            out += value
        else:
            out += part
    return out, spans
