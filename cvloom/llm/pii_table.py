"""The labelled table that the personal-information model is trained on.

Lines are put together by a grammar: a beginning, and one or two clauses that bring an item or something that looks like one.
No line is one of the test tables', but many paraphrase kinds of lines that occur there (see README). `{kind:filler}` marks an item; fillers are drawn by rule, so that the model learns the
shape of items and the words around them and not particular names or numbers. Fillers in `<...>` are no personal information.
"""

from __future__ import annotations

import random
import re

#: Beginnings, mostly work as people describe it.
BEGINNINGS = """
Kept the minutes of the steering group
Planned the winter timetable
Cut waiting times at the counter by <n>%
Sorted incoming post for <n> departments
Coached junior analysts
Translated user guides into <n> languages
Wired test benches and <tool> loggers
Ran the evening shift at the plant in <city>
Balanced petty cash every Friday
Drew up staffing plans in <tool>
Answered supplier queries within <n> hours
Wrote unit tests for the billing engine
Looked after the seed library
Tidied <big> customer records
Negotiated freight rates, saving <n>% a year
Prepared tender papers
Checked the cold chain across <n> depots
Moved old spreadsheets to <tool> and <tool>
Led weekly stand-ups of <n> people
Built dashboards with <tool>
Taught evening classes in <tool>
Opened the shop at dawn
Managed returns and refunds
Handled complaints from patients
Reviewed pull requests
Shipped <n> releases in <year>
Repaired looms and winding machines
Counted stock twice a month
Wrote grant reports
Sampled river water near <city>
Surveyed roofs by drone
Fixed bugs in the tax form generator
Organised the summer fair
Drove the school bus
Set the type for the parish paper
Introduced code freezes before holidays
Calibrated scales and sensors
Rewrote the onboarding guide
Volunteered at the food bank
Edited podcasts about gardening
Served as fire warden
Kept bees on the office roof
Digitised <big> index cards
Ordered spare filters
Welcomed visitors at reception
""".strip().splitlines()

#: Clauses with an item, to follow a beginning.
CLAUSES = """
 with {person:name}
 with {title} {person:surname}
 with {person:name} and {person:name}
 together with {person:name}
 alongside {title} {person:name}
 alongside {person:name}
 under {person:name}
 under {title} {person:surname} in <city>
 under the eye of {person:name}
 for {person:name}
 for {title} {person:surname}
 for {person:name} and <n> others
 on behalf of {title} {person:surname}
, supervised by {person:name}
, approved by {title} {person:name}
, signed off by {person:name}
 - checked by {person:name}
 – reviewed by {title} {person:surname}
, reporting to {person:name}
, reporting to {title} {person:surname}
 and reported to {person:name}
, as deputy to {person:name}
, standing in for {person:name}, who was ill
; thanks to {person:name}
; also {person:name}
; also {title} {person:surname}
; manager {person:name}
; boss: {title} {person:name}
; patron {person:name}
; chair {person:name}
; mentor {person:listed}
; {person:name}
; {title} {person:surname}
, {person:name}
 / {person:name}
 ({person:name})
, mostly by {person:name}
 until {person:name} took over
 next to {person:name}, our chair
, helped by {person:name}, {person:name} and {person:name}
; see {email:mail}
; {email:mail}
, {email:mail}
 – {email:mail}
 / {email:mail}
 ({email:mail})
 ({email:mail}
 <{email:mail}>
; mail {email:mail} for details
, reachable at {email:mail}
, with copies to {email:mail}
 via {email:mail} or {email:mail}
 from {email:mail}
; write to {email:mail}.
; phone {phone:phone}
; {phone:phone}
, {phone:phone}
 – {phone:phone}
 / {phone:phone}
 ({phone:phone})
 ({phone:phone}
, tel. {phone:phone}
, ph. {phone:phone}
 on {phone:phone}
 under {phone:phone} day and night
; hotline {phone:phone}
; mobile {phone:phone} or {phone:phone}
; fax {phone:phone}, second floor
 (call {phone:phone})
; ring {phone:phone} first
 at {address:address}
 at {address:address} for <n> months
; address {address:address}
; office: {address:address}
, from {address:address}
 – {address:address}
 ({address:address})
, based at {address:address}, close to the station
 out of {address:address}
 near {address:address}
 and moved to {address:address}
, then at {address:address}; {phone:phone}
 ({idlabel} {id_number:id})
 ({idlabel}: {id_number:id})
, {idlabel} {id_number:id}
; {idlabel} {id_number:id} was shown
; {idlabel} #{id_number:id}
; {idlabel}={id_number:id}
 under {idlabel} {id_number:id}
 as holder of {idlabel} {id_number:id}
; {id_number:id} ({idlabel})
; gave {id_number:id} as {idlabel}
; {id_number:id} served as proof of who I am
; bank account opened on {id_number:lettered}
; identified by {id_number:lettered}
""".strip("\n").splitlines()

#: Whole lines with items.
WHOLE = """
{person:name} was my first supervisor
{person:name} and {person:name} ran the office
{title} {person:surname} chaired the panel
{title} {person:name} examined the thesis
Supervisor: {person:name}
Superior: {title} {person:surname}
Manager {person:name} can vouch for this
Manager ({phone:phone}) can vouch for this
Reference: {person:name}, head of logistics
Reference: {title} {person:surname} / {email:mail}
Reference – {person:name}, purchasing
Reference – {person:listed}, purchasing
As {person:name} put it at the farewell, waste went down
As {title} {person:surname} put it at the farewell, waste went down, {email:mail}
As {person:listed} put it at the farewell, waste went down
Referees: {person:name} and {title} {person:name}
Met {person:name} and {person:name} each week
Deputy of {person:name} and {person:name}
Assistant of {title} {person:surname}, later of {person:name}
Secretary to {person:name}
Mentor {person:name}, then {person:name}
Trained by {person:name} for <n> months
Hired by {person:name} ({email:mail})
Taught {person:name} and <n> more apprentices
Team of {person:name}, room <n>
Took the post of {person:listed} in <year>
Looked after the diary of the director, {person:name}, for a year
Kept house for the consul, {title} {person:surname}, in <city>
Sworn to secrecy by {person:name} as clerk
Made charts for {person:name}; others gave the talk in <city>
Calls with {person:name}, head of audit
Contact {person:name}, {phone:phone}
Contact: {email:mail}, {phone:phone}
Contact for partners: {email:mail}
Contact for partners: {phone:phone}
E-mail: {email:mail}
Email {email:mail} / Tel {phone:phone}
Mails to mailto:{email:mail} were mine to answer
Mails sent to <{email:mail}> were mine to answer
{email:mail} was my list
{email:mail} reaches me
Copy {email:mail} on everything
Questions: {email:mail}; {person:name}
Complaints went from {email:mail} to {email:mail}
Looked after {email:mail} and {email:mail} (answers within <n> h)
The desk's address {email:mail}, known to all clients
Tel: {phone:phone}
Phone: {phone:phone}
Mobile {phone:phone}; {email:mail}
Cell {phone:phone}
Ring {phone:phone} for a recommendation
Call {phone:phone} or {phone:phone}
Rang {phone:phone} at each change of shift
Text {phone:phone} for slots
Sat at the crisis line {phone:phone} at weekends
Emergency line {phone:phone} for the late team; {person:name}
Her number: {phone:phone}
Reached at {phone:plain_phone} every evening to lock the doors
Painted {phone:plain_phone} on both vans
Typed {phone:plain_phone} a thousand times
Signal {phone:plain_phone} for parcels
The chief's cell: {phone:phone}
Posters with {phone:phone} went up everywhere
Fax {phone:phone}, hall <n>
Lives at {address:address}
{address:address}
{address:address} is where I stay
Advised {person:name} in planning matters
Followed {person:name} in running the shop
Lived in {address:address} while abroad
Home: {address:address}
Postal address: {address:address}
Address: {address:address}
Letters to {address:address}, care of the landlord
Fetched goods from {address:address} before noon; {phone:phone}
Brought meals to {address:address} on Sundays
Head office ({address:address}) was my place of work
Started a shop beside my house, {address:address}, in May
Put the store at {address:address} in order
Ran a practice at {address:address} / {phone:phone}
House calls, for instance {address:address}
{idlabel}: {id_number:id}
{idlabel} {id_number:id}, valid until <year>
{idlabel} {id_number:id}
Vetting passed ({idlabel} {id_number:id})
Vetting passed ({idlabel} {id_number:id}), {person:name}
Taxed as self-employed, {idlabel} {id_number:id}, since <year>
Permit names {idlabel} #{id_number:id}
Wages paid under {idlabel} {id_number:id}
Let in on {idlabel} {id_number:id} on day one
Health card carries {id_number:id} as {idlabel}
File notes {id_number:id} ({idlabel}), seen
Checks complete, {idlabel}={id_number:id}
Handed in {id_number:lettered} to show who I am
Handed in {id_number:id} as proof of age – {email:mail}
Got my wages account with {id_number:lettered} / {phone:phone}
Got my wages account with {id_number:id}
Gate pass issued for {idlabel} {id_number:id}
""".strip().splitlines()

#: Clauses and lines about goods, places, products and numbers, without an item.
PLAIN_CLAUSES = """
 in <tool>
 with <tool> and <tool>
 for <n> clinics
 for the sales office
 with <n>% less waste
, <n> hours a week
, at half the cost
 before the audit
 and won Best Stand of <year>
, serving <big> guests
, reaching <big> people
 for <big> readers
 in <city> and <city>
 on the site in <city>
 with three colleagues
 after a review by the board
, and halved the backlog
; see chapter <version>
 under strict deadlines
 for the <word> Bridge opening
 near the <word> Town Hall
 on <street>
; parts <ssnlike> and <passlike>
 from Shed <n> to Hall <n>, <city>
 to Room <n>, <city>
 to Hall <n>, <city>
 under order <order>
, ticket <abc>-<five>
; invoice <threefour>
, batch <sixsix>
, badge <six>
, version <version>
 for Rs <seven>
 for EUR <commas>
""".strip("\n").splitlines()

PLAIN = """
Ranked <ssnlike> in the list of goods
Graded <ssnlike> on the stock index
Found valve <ssnlike> in the wrong bin
Counted item <passlike> on the pallets
Stored pump <passlike> in the cellar
Kept article <passlike> in the catalogue
Shipped pallet <threefour> to the coast
Recalled lot <threefour> after a test
Closed the books of account <threefour>
Balanced journal <threefour> at the end of the month
Badge STF <six> replaced badge STF <six>
Locker <five>, badge <six>, parking <n>
Delivered order <order> of <n> crates
Packed <n> crates for order <order> in time
Solved ticket <abc>-<five> and <n> like it
Answered case <abc>-<five>
Published build <build> on the @dev-room board
Sent notes of build <build> to the @night-team
Tagged release <version> of the planner
Spoke at the ideas@noon round
Founded the people@work circle
Read probe <sixsix> every <n> minutes
Printed label <sku> on <n> boxes
Filed folder <folder> behind <folder>
Filled in form 12B for <n> farmers
Launched the Grey Badger calendar on port <four>
Replaced the White Stork sorter on port <four>
Put <n> racks into Hall <n>, <city>
Fetched parcels from Gate <n>, <city>
Carried crates from bay <n> to Hall <n>, <city>
Trains leave from Platform <n>, <city>
Desk in Room <n>, Wing <n>
Exchanged keys <code> <six> for <code> <six>
Handed out passes <code> <six> and <code> <six>
Wrote <code> <sku> on <n> shelves
Marked <code> <sku> and <n> more
Clerk <code> <five> of the year <year>
Called flush() <six> times a night
Reached <commas> readers in <year>-<year>
Spent a budget of Rs <seven>
Raised EUR <commas> for the roof
Named Trainee of the Year in <year>
Named Shift of the Month in <year>
Brought Project Golden Anchor to its end
Brought Programme Quiet Harvest to its end
Cooked for the opening of the <word> River Station in <city>
Cooked for the opening of the <word> Garden Theatre in <city>
Painted the <street> hall in <city>
Measured <street> and <street> for <n> shops
Planted <n> trees along <street>
Mapped <street> and <street> in <n> days
Swept <street> and <street> for <n> winters
Patrolled <street> and <street>
Adopted <brand> planner on port <four>
Configured <brand> gateway on port <four>
Presented <brand> toolkit to <n> guests
Replaced <brand> engine with <brand> runtime
Maintained <brand> and <brand> for <n> users
Serviced <n> <word> Classic boilers and <n> pumps
Tuned <n> <word> Prime pianos and <n> organs
Put up <n> signs on <street>
Sold <n> <word> Prime lamps and <n> bulbs
Built <n> <word> Royal tables and <n> benches
Bought from <word> <word> Ltd and <word> <word> Group
Merged <word> <word> Inc with <word> Partners
Audited <word> & <word> Bank
Tested the Red Maple pilot on two lines
Tested the Deep Lake pilot on two lines
Met ISO 9001 and clause <version>
Ran a kiosk in Köln and a bar in Orléans
Sang in the Señor choir – première in <city>
Wrote Greek labels (Γενικές πληροφορίες)
Drew the poster “Весенний праздник” for the club
Filed papers under Κείμενο
Worked in Paris, London and New York
Spoke English, French and Polish
Studied at <word> University and <word> College
Learned Power Point, Google Sheets and Apple Keynote
Certified by Cloud Native Foundation in <year>
Flew to South Africa and Costa Rica
On call from Monday to Friday
Opened Monday to Friday, closed at noon
Grew sales from <n> to <big> units
Fell from <n> to <n> errors a week
Scored <n> of <n> in the safety test
Open from <n>:30 to <n>:45
Between <year> and <year> on leave
Wrote <n> pages of REST and SQL notes
Ran TCP and UDP tests on port <four>
Joined as Senior Clerk, left as Office Head
Worked as Senior Data Analyst for the Board
Member of the Works Council
""".strip().splitlines()

#: Documents of identity and how they are called.
ID_LABELS = ["social security number", "tax ID", "Aadhaar no.", "identity card no.", "passport number", "driver's licence", "SSN:", "residence permit", "national identity number", "PAN no.", "SSN", "social security no.", "tax payer no.", "Aadhaar", "UID no.", "national ID", "passport no.", "passport", "travel document", "driving licence", "licence no.", "PAN", "permanent account no.", "identity card"]
TITLES = ["Mr.", "Mrs.", "Ms.", "Dr.", "Dr", "Prof.", "Mr", "Shri", "Smt."]
_ONSETS, _VOWELS, _CODAS = "b br c d dr f g gr h j k l m n p qu r s st t th v w z".split(), "a e i o u ae ia".split(), "n r l s nd rk m v sh ck".split()
_MARKED = dict(zip("aeiouc", "áéíöüç"))
_STREETS = "Road Street Lane Avenue Close Court Drive Row Way Boulevard Rd Ave St. Dr Square Terrace".split()
_BRAND_A, _BRAND_B = "Copper Quiet Silver North Amber Wild Bright Green Stone Rapid Open Blue".split(), "Finch Comet River Otter Lantern Maple Falcon Harbour Cloud Heron Bridge Fox".split()
#: Names of streets where the kind goes before the name, or is joined to it.
_BEFORE = "rue|rue de la|avenue de|place|via|calle|calle de|ulica|ul.|rua|avenida|boulevard de|corso|piazza|plaza".split("|")
_JOINED = "straße strasse weg gasse platz allee straat gatan vej".split()
_TOOLS = "Python Java Kafka Spark Excel SAP Figma Docker Redis C++ C# R Go SQL JIRA MongoDB TypeScript PostgreSQL".split()


class Filler:
    """Draws fillers by rule."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self, parts: int) -> str:
        w = "".join(self.r.choice(_ONSETS) + self.r.choice(_VOWELS) for _ in range(parts)) + self.r.choice(_CODAS)
        if self.r.random() < 0.1:
            k = self.r.randrange(len(w))
            w = w[:k] + _MARKED.get(w[k], w[k]) + w[k + 1 :]
        return w.capitalize()

    def d(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def surname(self) -> str:
        s, kind = self.word(2), self.r.random()
        if kind < 0.12:
            return f"{s}-{self.word(2)}"
        return self.r.choice(["O’", "O'", "D'"]) + s if kind < 0.17 else s

    def name(self) -> str:
        given = self.word(self.r.choice([1, 1, 2]))
        kind = self.r.random()
        if kind < 0.2:
            return f"{given[0]}. {self.surname()}"
        if kind < 0.35:
            return f"{given} {self.word(1)[0]}. {self.surname()}"
        if kind < 0.42:
            return f"{given.upper()} {self.surname().upper()}"
        if kind < 0.45:
            return f"{given} {self.r.choice(['van', 'de', 'von', 'di', 'al'])} {self.surname()}"
        return f"{given} {self.surname()}"

    def listed(self) -> str:
        s = self.surname()
        return f"{s.upper() if self.r.random() < 0.7 else s}, {self.word(2) if self.r.random() < 0.7 else self.word(1)[0] + '.'}"

    def city(self) -> str:
        return self.word(2) if self.r.random() < 0.6 else f"{self.word(1)} {self.r.choice(['Hill', 'Bay', 'Cross', 'Vest', 'East', 'Point', 'Heights', self.word(1)])}"

    def street(self) -> str:
        return f"{self.r.choice(['Old ', 'Fourth ', '']) if self.r.random() < 0.2 else ''}{self.word(2)}{' ' + self.word(1) if self.r.random() < 0.2 else ''} {self.r.choice(_STREETS)}"

    def address(self) -> str:
        r, n = self.r, str(self.r.randint(1, 420))
        kind = r.random()
        if kind < 0.1:
            return f"{n}{r.choice([',', '', ' bis'])} {r.choice(_BEFORE)} {self.word(2)}, {r.choice(['', self.d(5) + ' '])}{self.city()}"
        if kind < 0.2:
            street = r.choice([self.word(2) + r.choice(_JOINED), f"{r.choice(_BEFORE).capitalize()} {self.word(2)}"])
            return f"{street} {n}, {r.choice(['', self.d(5) + ' '])}{self.city()}"
        house = r.choice([n, n, n, f"{n}{r.choice('abc')}", f"Flat {r.randint(1, 40)}{r.choice('ABCD')}, {n}", f"Plot {r.randint(1, 90)},", f"No. {n},", f"{n}/{r.randint(1, 20)},", f"House {n},", f"Apt {r.randint(1, 40)}, {n}", f"Unit {r.randint(1, 40)}, {n}"])
        a = f"{house} {self.street()}"
        if r.random() < 0.2:
            a += f", Apt {r.randint(1, 30)}"
        a += f", {self.city()}"
        if r.random() < 0.4:
            a += r.choice([" ", " - "]) + self.d(6)
        return a.upper() if r.random() < 0.1 else a

    def phone(self) -> str:
        d = self.d
        return self.r.choice(
            [f"+44 20 {d(4)} {d(4)}", f"0{d(4)} {d(3)} {d(3)}", f"+91 {d(5)} {d(5)}", f"+91-{d(10)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)} ext. {d(2)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"00{d(11)}", f"+44 (0){d(4)} {d(6)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+49 {d(3)} {d(7)}", f"+33 {self.d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"]
        )

    def plain_phone(self) -> str:
        return self.r.choice(["00", "00", "0", "+"]) + self.d(self.r.choice([10, 11]))

    def id(self) -> str:
        d, up = self.d, lambda n: "".join(self.r.choice("ABCDEFGHJKLMNPRSTUVXYZ") for _ in range(n))
        return self.r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}", d(12), f"{up(1)}{d(7)}", f"{up(1)}{d(7)}", f"{up(2)}-{d(2)} {self.r.randint(1995, 2024)} {d(7)}", f"{up(5)}{d(4)}{up(1)}"])

    def lettered(self) -> str:
        """A number whose form alone says that it is of a document."""
        d, up = self.d, lambda n: "".join(self.r.choice("ABCDEFGHJKLMNPRSTUVXYZ") for _ in range(n))
        return self.r.choice([f"{up(5)}{d(4)}{up(1)}", f"{up(5)}{d(4)}{up(1)}", f"{up(1)}{d(7)}", f"{up(2)}-{d(2)} {self.r.randint(1995, 2024)} {d(7)}", f"{d(4)} {d(4)} {d(4)}"])

    def mail(self) -> str:
        r = self.r
        a, b = self.word(1).lower(), self.word(2).lower()
        local = r.choice([f"{a}.{b}", f"{a}_{b}", f"{a}-{b[0]}", f"{a}+{b}{r.randint(1, 9)}", f"{a[0]}{b}", f"{b}{r.randint(1, 99)}", f"{a}.{b}{r.randint(1, 999)}"]).encode("ascii", "ignore").decode()
        domain = r.choice([f"{self.word(2)}", f"mx.{self.word(2)}", f"{self.word(1)}-{self.word(1)}", f"post.{self.word(2)}", f"staff.{self.word(2)}"]).lower().encode("ascii", "ignore").decode() + "." + r.choice(["com", "org", "example", "test", "invalid", "net"])
        how = r.random()
        if how < 0.6:
            m = f"{local}@{domain}"
        elif how < 0.7:
            m = f"{local} @ {domain}"
        elif how < 0.8:
            m = f"{local}(at){domain}"
        elif how < 0.9:
            m = f"{local} [at] {domain.replace('.', ' [dot] ')}"
        else:
            m = f"{local} AT {domain.replace('.', ' DOT ')}"
        return m.upper() if r.random() < 0.08 and how < 0.7 else m

    def plain(self, kind: str) -> str:
        d, r = self.d, self.r
        return {
            "word": lambda: self.word(2), "brand": lambda: f"{r.choice(_BRAND_A)} {r.choice(_BRAND_B)}", "code": lambda: "".join(r.choice("ABCDEFGKLMPRSTUW") for _ in range(r.choice([3, 3, 4]))), "n": lambda: str(r.randint(1, 60)), "big": lambda: str(r.randint(1, 999) * r.choice([10, 100, 100])), "tool": lambda: r.choice(_TOOLS), "city": self.city, "given": lambda: self.word(1),
            "surname": lambda: self.word(1), "street": self.street, "ssnlike": lambda: f"{d(3)}-{d(2)}-{d(4)}", "passlike": lambda: r.choice("ABCDEFGHKLMPRTY") + d(7),
            "threefour": lambda: f"{d(4)} {d(4)} {d(4)}", "order": lambda: f"{d(4)}-{d(2)}-{d(5)}", "build": lambda: f"{r.randint(2015, 2025)}.{d(2)}.{d(2)}-{d(4)}", "version": lambda: f"{r.randint(1, 12)}.{r.randint(1, 12)}.{r.randint(1, 9)}" + (f".{d(1)}" if r.random() < 0.5 else ""),
            "five": lambda: d(5), "four": lambda: d(4), "six": lambda: d(6), "seven": lambda: d(7), "year": lambda: str(r.randint(1995, 2025)), "sixsix": lambda: (lambda x: f"{x}-{x}")(d(6)),
            "sku": lambda: f"KD-{d(4)}-{d(3)}", "folder": lambda: f"AB{d(4)}" + r.choice("ABCDF"), "commas": lambda: f"{r.randint(1, 99)},{d(3)},{d(3)}", "abc": lambda: r.choice(["BUG", "DEV", "REQ"]),
        }[kind]()


def fill(line: str, f: Filler) -> tuple[str, list[tuple[int, int, str]]]:
    """A line with its fillers drawn, and its items as (start, end, kind)."""
    text, items, at = "", [], 0
    for m in re.finditer(r"\{(\w+)(?::(\w+))?\}|<(\w+)>", line):
        text += line[at : m.start()]
        at = m.end()
        if m[3]:
            text += f.plain(m[3])
        elif m[2]:
            item = getattr(f, m[2])()
            items.append((len(text), len(text) + len(item), m[1]))
            text += item
        else:
            text += f.r.choice(TITLES if m[1] == "title" else ID_LABELS)
    return text + line[at:], items


def labelled(size: int = 6_000, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """`size` lines of the grammar: (text, items as (start, end, kind))."""
    f, out = Filler(seed), []
    r = f.r
    for _ in range(size):
        kind = r.random()
        if kind < 0.32:
            line = r.choice(WHOLE)
        elif kind < 0.5:
            line = r.choice(PLAIN)
        elif kind < 0.62:
            line = r.choice(BEGINNINGS) + r.choice(PLAIN_CLAUSES)
        else:
            line = r.choice(BEGINNINGS)
            line += r.choice(PLAIN_CLAUSES) if r.random() < 0.3 else ""
            line += r.choice(CLAUSES)
        # a second item often follows, after a mark
        if r.random() < 0.12 and not line.endswith((".", ">")):
            line += r.choice(["; ", ", ", " / ", " – ", "; also ", ", also "]) + r.choice(["{person:name}", "{title} {person:surname}", "{email:mail}", "{phone:phone}"])
        text, items = fill(line, f)
        if r.random() < 0.12 and not text.endswith((".", ")")):
            text += "."
        out.append((text, items))
    return out
