"""Labelled texts for problem 1: sentences and forms filled with items whose places are known.

Each family of sentences is worded for itself (shop, clinic, landlord, parcel, bank form, chat and so on, in English, Thai
and German). Families in HELD are never fitted: they calibrate the thresholds and measure precision and recall. Names are
those listed here and a bounded sample of the slips' own name fields whose title or legal form tells persons from
organisations. The result depends on nothing but the sample and the seed.
"""

from __future__ import annotations

import random
import re
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipweave.functions.slips import BANKS
from slipweave.llm import lexicon, names
from slipweave.llm.pii import Finder, NameModel, train

#: Names sampled from the name fields (those of lowest hash), and labelled texts made.
SAMPLE_NAMES, LABELLED_TEXTS = 20_000, 5_400

_GIVEN = (
    "James Olivia Mohammed Fatima Wei Mei Carlos Lucia Ahmed Aisha Hiroshi Yuki Anders Ingrid Pierre Camille Giulia Marco Priya Arjun Oluwaseun Ngozi Kofi Amara Dmitri Svetlana Piotr Agnieszka Nguyen Linh Jin Soo Minh Thanh "
    "Somchai Malee Anan Kanya Prasert Suda Wichai Nok Jonathan Robert Hannah Grace Samuel Emily Thomas Charlotte Daniel Sophie Patrick Siobhan Jorge Valentina Mateo Isabel Lars Freya Otto Heidi Franz Greta Zoë José Chloé René"
).split()
_FAMILY = (
    "Smith Johnson Okafor Hassan Chen Wang Garcia Rodriguez Tanaka Sato Larsen Eriksson Dubois Lefebvre Rossi Bianchi Patel Raghunathan Mensah Adeyemi Ivanov Petrova Kowalski Nowak Tran Pham Kim Park Whitaker Hargreaves "
    "O'Connor McAllister Fernandez Mendoza Müller Schneider Weber Hofmann Jaidee Srisai Wongsuwan Chaiyasit Boonmee Rattanakorn Suksawat Thongchai Sanderson Blackwood Fitzgerald Montgomery Delgado Ferreira Lindqvist Haugen Özdemir García"
).split()
_GIVEN_TH = "สมชาย สมหญิง มาลี วิชัย ประเสริฐ กานดา อนันต์ สุดา ปิยะ นภา ธีรพงษ์ อรทัย ชูชาติ พิมพ์ใจ กิตติ รัตนา วรรณา ศิริพร ณรงค์ จันทร์เพ็ญ".split()
_FAMILY_TH = "ใจดี ศรีสุข บุญมี ทองคำ สุขสวัสดิ์ วงศ์สุวรรณ รักไทย แก้วมณี พรหมมา ชัยสิทธิ์ เจริญสุข อินทรชัย แสงทอง มั่นคง พูนผล".split()
_TITLES = ["K. ", "Mr ", "Mrs ", "Ms. ", "Miss ", "Dr ", "Khun ", "K. ", "Mr. ", "Prof. ", "Dr. ", "Ms "]
_THAI_TITLES = ["นาย", "นาย ", "นาง", "นาง ", "นางสาว", "นางสาว ", "น.ส.", "น.ส. ", "คุณ", "คุณ "]
_FIRMS = ["Summit Office Supply Ltd", "Blue Door Bakery", "Northwind Traders", "Pine & Co.", "Delta Print House", "Evergreen Cleaning Services", "บริษัท ฟ้าใหม่ ขนส่ง จำกัด", "ร้านดอกไม้หน้าตลาด", "Kaiser Bau GmbH", "Union Auto Parts Co., Ltd."]

_PLACE = [a + b for a in ("Ash", "Brook", "Clear", "Fair", "Glen", "Hart", "King", "Long", "Oak", "Stan", "West", "Wood") for b in ("field", "ford", "ham", "ley", "mouth", "ton", "water")] + ["New Haven", "Saint Paul", "Port Elm", "Upper Dale", "San Mateo", "Ban Mai", "Nong Kha", "Bang Na"]
_STREET = "Station Park Church Mill Victoria Queens Maple Cedar Elm Orchard Garden Bridge Castle Market Chapel Lake Hill Spring River Sunset".split()
_KIND = "Road Street Lane Avenue Drive Way Court Close Square Boulevard Crescent Terrace Gardens Grove Rd St Ave Blvd Place".split()
_SOI = "Ruamjai Sukjai Pattana Chalong Wattana Prasan Thip Arun".split()
_ROMANCE = ["rue de la Gare", "rue Victor Hugo", "avenue des Ormes", "via Garibaldi", "via San Marco", "calle Mayor", "calle del Sol", "avenida Central", "rua do Porto", "chemin du Bois", "piazza Dante", "boulevard Saint-Michel"]
_GERMAN = ["Hauptstraße", "Schulstraße", "Bergweg", "Kirchgasse", "Goetheplatz", "Am Alten Markt", "Lindenallee", "Auf der Höhe", "Im Winkel", "Mozartstr.", "Schillerstrasse", "An der Brücke", "Talgasse"]
_THAI_PLACE = [a + b for a in ("บาง", "บ้าน", "ท่า", "หนอง", "คลอง", "ดอน", "ห้วย", "เขา", "วัง") for b in ("ใหม่", "แก้ว", "ทราย", "โพธิ์", "ยาว", "ขวาง", "บัว", "ไทร", "นา", "สูง")]
_THAI_BANK = [a + b for a in ("ทะเล", "ภูเขา", "ดวงดาว", "ต้นไม้", "แม่น้ำ", "ทองคำ", "ชาวนา", "เมืองใหม่", "ดอกไม้", "สายฝน") for b in ("", "พาณิชย์", "ออมทรัพย์", "การเงิน")]
_FOREIGN, _FOREIGN_END = "โกลบอล เมโทร อีซี่ สมาร์ท ซิตี้ ควิก แคปิตอล เน็กซ์ สกาย ยูไนเต็ด พรีเมียม เอเชีย".split(), ["เพย์", "แบงก์", "วอลเล็ต", "มันนี่", "ลิงก์", "", " ดิจิทัล"]
_WORDS = "garden river stone cloud maple silver north forest ocean paper market orange coffee desk studio travel cargo house".split()

#: Families: sentences with slots in braces. {name} may have a title, {plain} has none; {id} is a number, {doc} a document with letters.
FAMILIES: dict[str, list[str]] = {
    "shop": [
        "{name} picked up the parcel this afternoon", "Gave {name} a voucher because the kettle was broken", "Refund {money} goes to {name}, receipt {bill}", "Order {bill} belongs to {plain}; reach them at {phone}",
        "Returned by {name} without a receipt", "The lady left her number: {phone}", "Deliver the sofa to {addr} before noon", "Please invoice {firm} and not {name}", "Email the warranty to {mail}", "{plain}, {phone}, wants two boxes",
        "Loyalty card in the name of {plain}", "Ask {name} whether the blue one is fine", "Sold {num} chairs to {firm}", "Serial {bill} scanned at till {num}", "{firm} settled invoice {ref}",
    ],
    "clinic": [
        "Patient {name} was seen at {clock}", "{name} after she showed her {idword} {id}", "Insurance no {bill}, next visit {date}", "Next of kin: {plain}, {phone}", "Her passport {doc} was copied at reception", "Lives at {addr} with her son {plain}",
        "Appointment letter sent to {mail}", "Dr {plain} will ring back on {phone}", "{name} and {name} share a room", "ID {id}, born {date}", "My name is {plain} and I need a new appointment", "National id {id} does not fit the file of {plain}",
        "Emergency contact {plain} ({phone})", "Results for {name} are not in yet", "SSN {id}", "{idword}: {id}", "{idword} no. {doc}", "Moved from {addr} to {addr} last year", "see {name}.", "{plain} rang back about the results",
    ],
    "landlord": [
        "{plain} pays the rent for {addr}", "New tenant at {addr} is {name}", "Keys for {addr} handed to {name} on {date}", "Deposit {money} from {plain} received, contract {ref}", "Write to the owner under {mail} or {mail}", "The flat at {addr} is empty",
        "{name} gave notice; call {phone} or {phone}", "Meter {bill} reads {num}", "Owner: {plain}\nHome: {addr}\nMobile: {phone}", "Cleaner {name} has the spare key", "{idword} {id} of the tenant is on file", "Plumber is {firm}, landline {phone}",
        "Both {plain} and {plain} signed", "Visit {addr}, then ring {name}", "rent for {num} weeks from {plain}", "{plain} - {addr}", "house is {addr}, ask for {plain}",
    ],
    "parcel": [
        "Ship to {plain}, {addr}", "Recipient: {name}\nStreet: {addr}\nPhone: {phone}", "Could not reach {name} under {phone}", "Parcel {ref} left with neighbour {plain}", "Sender {firm}, tracking {ref}", "Customs asked for {idword} {doc} of {plain}", "Return to {addr}",
        "Driver {name} rang at {clock}", "Weight {num} kg, fee {money}", "Forward everything to {addr}", "Notify {mail} on delivery", "c/o {plain}, {addr}", "deliver to: {addr}", "send to {addr} please", "address {addr} is wrong", "note to driver - {name} - {mail}",
    ],
    "chat": [
        "hi its {plain}, my new number is {phone}", "can u text {name} on {phone} thx", "ok sent it to {mail} just now", "who is {plain}??", "{plain} said he already sent {money}", "not me, that was {plain}", "pls dm {mail} or call {phone}", "lol {name} forgot again", "im at {addr} come by",
        "its order {bill} from {date}", "👍 thanks {name}!", "paid {firm} {money} ref {ref}", "my id is {id} and passport {doc}", "talk to {name} / {phone}", "w/ {name} now", "fyi {plain} ({phone}) ok", "ok w {name}", "{plain} and {plain} both sent {money}",
    ],
    "thai_office": [
        "{name} ส่งเอกสารมาแล้ว", "ฝากบอก {name} ให้โทรกลับ {phone}", "เบอร์ของ {name} คือ {phone}", "ที่อยู่จัดส่ง {addr}", "รบกวนส่งไปที่ {addr} ผู้รับ {name}", "หมายเลขบัตรประชาชน {id} ของ {name}", "พาสปอร์ต {doc} ชื่อ {plain}", "เมล {mail} ใช้ไม่ได้", "คุยกับ {name} แล้ว รอเอกสาร",
        "ผู้เช่า {name} ย้ายไป {addr}", "โอนแทน {name} จำนวน {money} บาท", "ใบแจ้งหนี้ {bill} ของ {firm}", "ติดต่อกลับ {phone} หรือ {mail}", "ชื่อ {plain} บัตร {id}", "ลูกชายชื่อ {plain} อยู่บ้านเลขที่ {addr}", "ออเดอร์ {ref} ยกเลิกโดย {name}", "{name} โทร {phone}", "จ่ายให้ {name} ครบแล้ว", "เลขพัสดุ {ref}",
        "บัตร {id} หมดอายุ", "พี่ {plain} รับของแทน", "ซื้อให้แม่ {plain}", "ผู้ติดต่อ {name}, ที่อยู่ {addr}, บัตร {id}, โทร {phone}, {mail}", "พร้อมเพย์ {phone}", "พร้อมเพย์ {id}", "ยอดคงเหลือ {money} บาท", "งวดที่ {num} จาก {num}", "ห้อง {num} ตึก {num}",
    ],
    "german": [
        "Herr {plain} wohnt in {addr}", "Bitte an {mail} schreiben", "Frau {plain} ist unter {phone} zu erreichen", "Rechnung {bill} über {money}", "Ausweis {doc} von {plain}", "Lieferung an {addr}", "Anruf von {plain}", "Die Firma {firm} hat überwiesen", "Kunde: {plain}, {addr}", "Neue Adresse: {addr}",
    ],
    "form": [
        "Account holder: {plain}\nAccount: {tail}\nBranch: {num}", "Name: {name}\nE-mail: {mail}\nTel: {phone}", "Payer: {party}\nPayee: {party}\nSum: {money}\nRef: {ref}", "From\n{party}\n{bank} {tail}\nTo\n{party}\n{bank} {tail}", "Receiver: {party}", "Sender: {party}",
        "ผู้รับ\n{party}\n{bank}\n{tail}", "ผู้โอน: {party}\n{bank} {tail}", "จาก\n{party}", "ไปที่\n{party}\n{bank}", "ชื่อบัญชี {party}", "ผู้ส่ง {party}", "ชื่อผู้รับ: {party}", "Account name {party}", "Paid to {party}", "Amount {money}\nFee {money}\nTransaction ID {ref}", "จำนวน {money} บาท\nเลขที่รายการ {ref}",
        "Date {date} {clock}", "{stamp}", "{stamp}", "{bank}\n{stamp}", "{ref}\n{stamp}", "Done\n{stamp}\nFrom {party}", "{stamp}\nTo {party}", "Ref {ref}\n{stamp}", "Terminal {bill} batch {num}", "Biller {bill} ref {ref}", "card ending {tail}", "ext. {num}", "รหัสบิล {bill}", "สาขา {num}", "ref 1: {bill}\nref 2: {bill}", "To {party}\n{tail}", "From {party}\n{bank}", "account {tail} and {tail}", "จาก {party}", "ถึง {party}", "{bank}\n{tail}", "{bank} {tail}", "{bank}", "{firm}", "{bank}\n{tail}\n{ref}",
        "memo {firm}", "{name} - {addr}", "{name} at {addr}", "rent {addr}", "for {addr}", "second one for {addr}, {mail}", "{mail} / {phone}", "numbers {phone} / {phone}", "phone: {phone}\nid: {id}", "memo: for {name}", "note: {addr}", "id {id}", "PromptPay {phone}", "PromptPay {id}", "{idword} {id}", "{name} {id}", "Contact {mail} {phone}", "mobile {hidden}", "slip total {money}", "{money} บ า ท", "ย อ ด ร ว ม {money} บ า ท", "ร า ย ล ะ เ อ ี ย ด",
    ],
    "letter": [
        "Dear {name},\nplease answer to {mail}.\nRegards,\n{plain}", "Yours sincerely\n{plain}\n{addr}\n{phone}", "I, {plain}, of {addr}, confirm the sale", "cc: {name}; {name}", "Signed: {plain}, {idword} {id}", "{firm}\nAttn. {name}\n{addr}", "In reply to your letter of {date}, reference {ref}", "Copy to {plain}", "{plain}\n{addr}",
    ],
    "desk": [
        "Jumped to {name}'s ticket {bill}", "Caller {plain} on {phone} is angry about {ref}", "Escalated to {name} at {clock}", "Left voicemail for {plain}", "mail from {mail}: asks where {money} went", "Same person, different {idword}: {doc}", "{plain} denies the payment to {firm}", "checked with {bank}, trace {ref}", "told {name} to write {mail}",
        "caller gave {phone} and {phone}", "wants a call at {phone} ext {num}", "two payments of {money} by {plain}", "case {bill} closed, {num} hours", "verified with {idword} {id}", "confirmed per phone with {name}", "{name} will send proof", "belongs to {plain}. Same as {ref}", "{plain} confirmed", "old address {addr}, new {addr}",
    ],
    "places": [
        "we live at {addr} now", "{plain} lives at {addr}", "he is staying at {addr} with friends", "My place is {addr}", "the office moved from {addr} to {addr}", "registered at {addr} since {date}", "born in {addr}", "found it outside {addr}", "{addr} is where {plain} works", "turn left at {addr}",
        "parked near {addr}, ticket {bill}", "the shop in {addr} closed", "a letter for {addr} came back", "residence: {addr}", "{addr}\n{phone}", "living in {addr}, {idword} no. {doc}", "office {addr} or {addr}", "come to {addr} at {clock}", "no one at {addr} with that name", "{idword} no. {doc}", "{idword} no {id}", "insurance no {bill}", "พักอยู่ {addr}", "อยู่ที่ {addr}",
    ],
    "thai_shop": [
        "{name} สั่งสองกล่อง", "ของหมด แจ้ง {name} แล้ว", "ส่งด่วนถึง {name} {addr}", "คืนเงิน {money} ให้ {name}", "เบอร์สำรอง {phone}", "ขอใบกำกับภาษีในนาม {firm}", "ชื่อผู้ซื้อ {plain} เลขบัตร {id}", "ส่งบิลไป {mail}", "บ้าน {addr} โทร {phone}", "รับเองโดย {name}", "คนโอนคือ {plain}", "โอนมาจาก {firm} {money} บาท", "รหัส {ref} เวลา {clock}", "{name} กับ {name} หารกัน",
    ],
    "misc_plain": [
        "the total is off by {money}", "no items on page {num}", "batch {num} of {num} done", "looks blurred, scan again", "version {num}.{num}.{num} installed", "see rule {num} in the manual", "Opening hours {clock} to {clock}", "On {date} we close early", "ไม่มีอะไรเพิ่มเติม", "รูปมืดมาก อ่านไม่ออก", "ยอดไม่ตรง ขาด {money}", "the same photo twice",
        "meet at noon, bring the form", "Summer sale starts Monday", "Please park behind the building", "@shopfront official page", "follow @news.daily for updates", "Bank Holiday on {date}", "รอตรวจสอบอีกครั้ง", "เอกสารครบถ้วน", "Bitte nicht knicken", "reference {ref} was used twice", "the two accounts {tail} and {tail} differ", "match {ref} {ref}", "bill {bill}, line {num}", "card {hidden}", "{firm} and {firm} merged",
    ],
}
#: Families that are not fitted: thresholds are calibrated on the first two, accuracy is measured on the others.
CALIBRATE, HELD = ("landlord", "thai_shop", "desk"), ("clinic", "letter", "german")
FITTED_FAMILIES = tuple(f for f in FAMILIES if f not in CALIBRATE + HELD)
_SLOT = re.compile(r"\{(\w+)\}")


class Maker:
    """Builds one text and remembers where its items lie."""

    def __init__(self, people: list[str], companies: list[str], seed: int):
        self.r = random.Random(seed)
        self.people, self.companies = people, companies
        self.text, self.items = "", []

    def put(self, s: str) -> None:
        self.text += s

    def item(self, kind: str, s: str) -> None:
        self.items.append((kind, len(self.text), len(self.text) + len(s)))
        self.text += s

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def other_digits(self, s: str) -> str:
        x = self.r.random()
        return s.translate(str.maketrans("0123456789", "๐๑๒๓๔๕๖๗๘๙" if x < 0.1 else "０１２３４５６７８９")) if x < 0.16 else s

    def a_person(self) -> str:
        x, r = self.r.random(), self.r
        if x < 0.55 and self.people:
            return r.choice(self.people)
        if x < 0.85:
            return " ".join([r.choice(_GIVEN), *([r.choice(_GIVEN)] if r.random() < 0.12 else []), *([r.choice(["de", "van", "bin", "von"])] if r.random() < 0.05 else []), r.choice(_FAMILY)])
        return f"{r.choice(_GIVEN_TH)} {r.choice(_FAMILY_TH)}"

    def name(self, titled: bool = True) -> None:
        n, r = self.a_person(), self.r
        thai = "฀" <= n[0] <= "๿"
        with_title = titled and r.random() < 0.5
        words, y = n.split(" "), r.random()
        title = r.choice(_THAI_TITLES if thai else _TITLES) if with_title else ""
        if len(words) == 2:
            first, last = words
            forms = (
                [(0.07, f"{last} {first}"), (0.11, " ".join(n.replace(" ", "")) if not title else n), (0.17, n.replace(" ", "")), (0.22, f"{first} {last[0]}."), (0.26, first if title else n)] if thai else
                [(0.07, f"{last}, {first}"), (0.12, f"{last.upper()} {first[0]}"), (0.18, f"{first} {last[0]}."), (0.23, n.upper()), (0.30, n.lower()), (0.35, f"{first[0]}. {last}"), (0.39, f"{first} {r.choice('ABDJKMNRST')}. {last}"), (0.44, last if title else n), (0.47, f"{first[0]}.{r.choice('ABJKMS')}. {last}")]
            )
            n = next((f for bound, f in forms if y < bound), n)
            if title == "K. " and " " not in n:
                title = ""
        self.put(title)
        self.item("NAME", n)

    def firm(self) -> None:
        x, r = self.r.random(), self.r
        n = r.choice(self.companies) if self.companies and x < 0.75 else r.choice(_FIRMS)
        if r.random() < 0.35:
            full, _, branch, _ = names.parse(n)
            n = " ".join(full).title() + (f" (Branch {branch})" if branch else "")
            n = n.upper() if r.random() < 0.2 else n
        self.put(n)

    def party(self) -> None:
        self.name() if self.r.random() < 0.55 else self.firm()

    def phone(self) -> None:
        d, r = self.digits, self.r
        m = "0" + r.choice("689") + d(1)
        cc = r.choice(["1", "7", "20", "27", "33", "34", "39", "44", "49", "55", "61", "65", "66", "81", "86", "91", "234", "353", "852"])
        s = r.choice([
            f"{m}-{d(3)}-{d(4)}", f"{m} {d(3)} {d(4)}", f"{m}.{d(3)}.{d(4)}", f"{m}{d(7)}", f"{m}-{d(7)}", f"+{cc} {d(2)} {d(3)} {d(4)}", f"+{cc}{d(9)}", f"+{cc}-{d(2)}-{d(3)}-{d(4)}", f"00{cc} {d(2)} {d(3)} {d(4)}", f"00{cc}-{d(2)}-{d(3)}-{d(4)}", f"(0{d(1)}) {d(3)}-{d(4)}",
            f"({d(3)}) {d(3)}-{d(4)}", f"0{d(1)}-{d(3)}-{d(4)}", f"+{cc} ({d(3)}) {d(3)}-{d(4)}", f"+{cc} {d(1)}-{d(4)}-{d(4)}", f"+{cc} {d(2)} {d(4)} {d(3)}", f"0{d(3)} {d(6)}", f"0{d(2)}/{d(7)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{cc} {d(2)} {d(4)} {d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}",
        ])
        self.item("PHONE", s if s[0] in "+(" else self.other_digits(s))

    def idword(self) -> None:
        self.put(self.r.choice(["ID card", "identity card", "citizen ID", "national ID", "SSN", "social security", "NRIC", "passport", "เลขบัตร", "เลขประจำตัว", "บัตรประชาชน", "ID no.", "tax id", "driving licence", "Ausweis"]))

    def id(self) -> None:
        d, r = self.digits, self.r
        c = d(13)
        if r.random() < 0.5:
            c = c[:12] + str((11 - sum(int(x) * (13 - i) for i, x in enumerate(c[:12])) % 11) % 10)
        s = r.choice([c, f"{c[0]}-{c[1:5]}-{c[5:10]}-{c[10:12]}-{c[12]}", f"{c[0]} {c[1:5]} {c[5:10]} {c[10:12]} {c[12]}"]) if r.random() < 0.72 else r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(4)} {d(4)} {d(4)}", d(9), f"{d(2)} {d(6)} {d(3)}"])
        self.item("ID_NUMBER", self.other_digits(s))

    def doc(self) -> None:
        d, r = self.digits, self.r
        letter = lambda n: "".join(r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(n))
        self.item("ID_NUMBER", r.choice([letter(2) + d(7), letter(2) + d(7), letter(1) + d(7), letter(1) + d(8), letter(1) + d(2) + letter(1) + d(2) + letter(1) + d(2), letter(2) + d(6), f"{letter(2)} {d(2)} {d(2)} {d(2)} A"]))

    def addr(self) -> None:
        r, n = self.r, str(self.r.randint(1, 399))
        place, other, zipped = r.choice(_PLACE), r.choice(_PLACE), self.digits(5)
        th = lambda: r.choice(_THAI_PLACE)
        sub = f"{n}/{r.randint(1, 99)}"
        street = f"{r.choice(_STREET)} {r.choice(_KIND)}"
        uk = f"{r.choice('BCDEGHLMNPRST')}{r.choice(['', 'S', 'N', 'L'])}{r.randint(1, 19)} {r.randint(1, 9)}{r.choice('ABDEFGH')}{r.choice('JLNPQRSTUW')}"
        soi = f"Soi {r.choice(_SOI)} {r.randint(1, 60)}"
        s = r.choice([
            f"{sub} หมู่ {r.randint(1, 12)} ต.{th()} อ.{th()} {zipped}", f"{n} ซ.{th()} ถนน{th()} แขวง{th()} เขต{th()}", f"{sub} ถ.{th()} ต.{th()} จ.{th()} {zipped}", f"{sub} หมู่ที่ {r.randint(1, 12)} ตำบล{th()} อำเภอ{th()}",
            f"{sub} Moo {r.randint(1, 12)}, Tambon {place}, Amphoe {other} {zipped}", f"{n} {street}, {place} {zipped}", f"{n} {street}, {place} {uk}", f"{n} {street} {place}".lower(), f"{n} {street}", f"{n}{r.choice('ab')} {street}, {place}", f"{r.choice(['Unit', 'Flat', 'Apt', 'Suite'])} {r.choice([f'{r.randint(1, 40)}', f'{r.randint(1, 40)}/{r.randint(1, 60):02d}', '4B'])}, {n} {street}, {place}",
            f"P.O. Box {n}, {place} {zipped}", f"PO Box {n}", f"ตู้ ปณ. {n} {th()} {zipped}", f"{r.choice(_GERMAN)} {n}, {zipped} {place}", f"{r.choice(_GERMAN)} {n}, {zipped} {place}", f"{n} {r.choice(_ROMANCE)}, {zipped} {place}", f"{r.choice(_ROMANCE)} {n}, {zipped} {place}", f"{n} {soi}, {place} {zipped}", f"Unit {r.randint(1, 40)}/{r.randint(1, 60):02d}, {n} {soi}, {place}",
        ])
        self.item("ADDRESS", s.lower() if r.random() < 0.08 else s)

    def mail(self) -> None:
        r = self.r
        local = r.choice([r.choice(_GIVEN).lower(), f"{r.choice(_GIVEN)}.{r.choice(_FAMILY)}".lower(), f"{r.choice(_GIVEN)[0]}_{r.choice(_FAMILY)}".lower(), r.choice(_WORDS), f"{r.choice(_SOI)}-{r.choice(_WORDS)}".lower()])
        local = re.sub("[^a-z0-9._-]", "", local) + r.choice(["", self.digits(2), "+" + r.choice(_WORDS), ""])
        host = r.choice([f"{r.choice(_WORDS)}.{r.choice(['com', 'org', 'co.uk', 'net', 'de', 'co.th', 'io', 'example', 'test'])}", f"{r.choice(_WORDS)}-{r.choice(_WORDS)}.com", f"mail.{r.choice(_WORDS)}.org"])
        x = r.random()
        if x < 0.6:
            s = f"{local}@{host}"
        elif x < 0.7:
            s = f"{local}＠{host}"
        elif x < 0.78:
            s = f"{local} @ {host}"
        elif x < 0.86:
            s = f"{local} (at) {host}"
        elif x < 0.95:
            s = f"{local}[at]{host.replace('.', '[dot]')}"
        else:
            s = f"{local} at {host.replace('.', ' dot ')}"
        self.item("EMAIL", s.upper() if r.random() < 0.06 else s)

    def ref(self) -> None:
        d, r = self.digits, self.r
        code = "".join(r.choice("ABCDEFGHKLMNPRSTVXZ") for _ in range(3))
        noisy = lambda s: "".join(r.choice("OIl") if r.random() < 0.02 else c for c in s)
        hidden = r.choice(["", "", "", "​", "­"])
        self.put(self.other_digits(r.choice([noisy(d(12)) + code + d(5), d(8) + hidden + d(4) + code + d(5), d(17), d(16), f"{code}-{d(6)}", f"{code[:2]}{d(4)}-{d(3)}{code[2]}", f"REF-{code[:2]}{d(4)}-{d(3)}{code[2]}", f"#{d(7)}", d(15) + code, f"TX{d(10)}"])))

    def bill(self) -> None:
        self.put(self.digits(self.r.choice([7, 8, 9, 10, 10, 11, 12, 12, 13, 13, 14, 15])))

    def num(self) -> None:
        self.put(str(self.r.choice([self.r.randint(1, 30), self.r.randint(100, 9999)])))

    def tail(self) -> None:
        d, r = self.digits, self.r
        self.put(r.choice([f"xxx-x-x{d(4)}-x", f"x-{d(4)}", f"*{d(4)}", f"xxxx{d(4)}", f"***{d(4)}", f"XXX-X-{d(5)}-X", f"{''.join(r.choice('ABCKLMRST') for _ in range(3))} *{d(4)}"]))

    def hidden(self) -> None:
        d = self.digits
        self.put(self.r.choice([f"xxx-xxx-{d(4)}", f"08x-xxx-{d(4)}", f"**** **** **** {d(4)}", f"+66 xx xxx {d(4)}", f"x-xxxx-xxxxx-{d(2)}-{d(1)}"]))

    def money(self) -> None:
        r = self.r
        self.put(f"{r.choice([r.randint(1, 999), r.randint(1000, 99999), r.randint(100000, 3000000)]):,}.{self.digits(2)}" if r.random() < 0.8 else f"{r.randint(10, 5000)}")

    def bank(self) -> None:
        r = self.r
        x = r.random()
        self.put(r.choice(BANKS) if x < 0.25 else r.choice(["ธนาคาร", "ธ.", "สหกรณ์"]) + r.choice(_THAI_BANK) if x < 0.5 else r.choice(_FOREIGN) + r.choice(_FOREIGN_END) if x < 0.65 else f"{r.choice(_STREET)} {r.choice(['Bank', 'Savings', 'Trust', 'Credit Union', 'Mutual', 'Commercial', 'Digital'])}")

    def clock(self) -> None:
        r = self.r
        self.put(r.choice([f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}", f"{r.randint(1, 12)}:{r.randint(0, 59):02d} pm", f"{r.randint(0, 23):02d}.{r.randint(0, 59):02d} น."]))

    def date(self) -> None:
        r = self.r
        d, m, y = r.randint(1, 28), r.randint(1, 12), r.randint(2018, 2026)
        month = r.choice("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())
        thai = r.choice("ม.ค. ก.พ. มี.ค. เม.ย. พ.ค. มิ.ย. ก.ค. ส.ค. ก.ย. ต.ค. พ.ย. ธ.ค.".split())
        self.put(r.choice([f"{d:02d}/{m:02d}/{y}", f"{y}-{m:02d}-{d:02d}", f"{d}.{m}.{y}", f"{d} {month} {y}", f"{month} {d}, {y}", f"{d} {thai} {y + 543}", f"{d:02d}-{m:02d}-{y % 100:02d}", f"{d:02d}/{m:02d}/{y % 100:02d}", f"{m}/{d}/{y % 100:02d}", f"{d} {thai}{(y + 543) % 100}", f"{y}年{m}月{d}日", f"{d} {' '.join(thai)}{(y + 543) % 100}"]))

    def stamp(self) -> None:
        r, d = self.r, self.digits
        x = r.random()
        if x < 0.5:
            self.date(), self.put(r.choice([" ", " - ", "T", ", "])), self.clock(), self.put(r.choice(["", f":{d(2)}", f" (UTC{r.choice('+-')}0{d(1)}:00)", f"{r.choice('+-')}0{d(1)}:30", " ICT", " +0700"]))
        else:
            t = f"{r.randint(2018, 2026)}{r.randint(1, 12):02d}{r.randint(1, 28):02d}"
            self.put(r.choice([f"{t}{d(6)}", f"{t}T{d(6)}{r.choice("+-")}0{d(1)}00", f"1{d(9)}", f"1{d(12)}", f"1{d(9)}.{d(3)}", f"{t[:4]}-{t[4:6]}-{t[6:]} {d(2)}:{d(2)}:{d(2)}.{d(6)} +00:00", "n/a", "??/??/???? --:--", f"{t[:4]}/{t[4:6]}/{t[6:]} {d(2)}:{d(2)}"]))

    def fill(self, sentence: str) -> None:
        at = 0
        for m in _SLOT.finditer(sentence):
            self.put(sentence[at : m.start()])
            slot = m.group(1)
            self.name(titled=False) if slot == "plain" else getattr(self, slot)()
            at = m.end()
        self.put(sentence[at:])


def make(people: list[str], companies: list[str], count: int = LABELLED_TEXTS, seed: int = 1, families: tuple[str, ...] = FITTED_FAMILIES) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, [(kind, start, end)]) of `count` texts of the families; lists of names may be empty."""
    out = []
    for i in range(count):
        m = Maker(people, companies, seed * 1_000_003 + i)
        family = m.r.choice(families)
        if family == "form" and m.r.random() < 0.7:  # forms are many short lines
            for k in range(m.r.randint(4, 10)):
                m.put("\n" if k else "")
                m.fill(m.r.choice(FAMILIES["form"]))
        else:
            for k in range(m.r.choice([1, 1, 2, 3])):
                m.put(m.r.choice(["\n", ". ", " / ", "; ", " - ", " ", ", "]) if k else "")
                m.fill(m.r.choice(FAMILIES[family]))
            m.put(m.r.choice(["", "", ".", "!"]))
        out.append((m.text, m.items))
    return out


def sample_names(reads: DataFrame, limit: int = SAMPLE_NAMES) -> tuple[list[str], list[str]]:
    """Persons' names without title and organisations' names, from at most `limit` values of the two name fields."""
    both = reads.select(F.col("receiver_name")["value"].alias("n")).unionByName(reads.select(F.col("sender_name")["value"].alias("n")))
    total = max(2 * reads.count(), 1)
    # A share of the hash space that holds about `limit` values, so no task sends more than its part of them.
    share = int(min(1.0, limit / total) * 2**31)
    part = both.where((F.length(F.trim("n")) > 3) & (F.pmod(F.xxhash64("n"), F.lit(2**31)) < share)).distinct()
    rows = sorted(part.limit(2 * limit).collect())
    people, companies = [], []
    for (n,) in rows[:limit]:
        kind = names.parse(n)[3]
        if kind == "o":
            companies.append(n)
        elif kind == "p":
            words = [w for w in n.split() if lexicon.exact_class(w) != lexicon.TITLE]
            words = words[1:] if len(words) > 2 and words[0] in ("K.", "K") else words
            bare = " ".join(words)
            glued = re.match("(?:นางสาว|น\\.ส\\.|นาง|นาย|คุณ)(?=[ก-ฮเ-ไ])", bare)
            bare = bare[glued.end() :] if glued else bare
            if 1 < len(words) <= 4 and "(" not in bare and bare:
                people.append(bare)
    return people, companies


def _half(items: list[str], odd: int) -> list[str]:
    """Half of the names, by their own text."""
    return [n for n in items if crc32(n.encode()) % 4 // 3 == odd]


def fitted(people: list[str], companies: list[str], count: int = LABELLED_TEXTS, seed: int = 1) -> Finder:
    """A finder fitted on three quarters of the names and the fitted families, calibrated on other names and families."""
    use_p, use_c = _half(people, 0), _half(companies, 0)
    words = {w for k in (lexicon.COMMON, lexicon.OTHER, lexicon.PHONE, lexicon.ID, lexicon.ADDRESS, lexicon.MAIL, lexicon.PARTY) for part in (lexicon.LATIN, lexicon.THAI) for w in part[k].split()}
    words |= {w for f in FITTED_FAMILIES for s in FAMILIES[f] for w in re.findall(r"[^\W\d_{}][\w฀-๿]*", _SLOT.sub("", s))} | set(_PLACE + _STREET + _KIND + _THAI_PLACE + BANKS)
    core = lambda n: " ".join(names.parse(n)[0])
    listed = [f"{g} {f}" for g, f in zip(_GIVEN, _FAMILY, strict=False)] + _GIVEN_TH + _FAMILY_TH
    # Both kinds of words weigh alike however many names there are.
    often = max(1, (len(use_p) + len(listed)) // max(len(words), 1))
    model = NameModel([(p, "p") for p in use_p + listed] + [(core(c), "o") for c in use_c + _FIRMS] + [(w, "x") for w in sorted(words)] * often)
    return train(make(use_p, use_c, count, seed), make(_half(people, 1), _half(companies, 1), count // 4, seed + 1, CALIBRATE), model)


def trained(reads: DataFrame, seed: int = 1) -> Finder:
    """A finder trained on labelled texts made with names of the slips; `Finder.save` and `load` keep it."""
    return fitted(*sample_names(reads), seed=seed)
