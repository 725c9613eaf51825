"""General vocabulary for problem 1, English, Thai and German: words that announce something, words that are no names."""

from __future__ import annotations

import re
from functools import lru_cache

NONE, PHONE, ID, ADDRESS, PARTY, MAIL, OTHER, COMMON, TITLE, ORG = range(10)

# Words by what they announce or are.
LATIN = {
    PHONE: "tel telephone phone mobile cell cellphone handy fax call calls called calling ring rang dial text sms whatsapp line contact telefon tel. mob reach promptpay",
    ID: "id identity passport ssn nric citizen citizenship licence license visa aadhaar national social security tax ausweis reisepass personalausweis pp dob identification card cards",
    ADDRESS: "address addr street ship shipped shipping deliver delivered delivery send lives living live resides residence resident moved home house rent office adresse anschrift wohnt lieferung located visit collect",
    PARTY: "from to receiver recipient sender beneficiary payee payer remitter name names account holder customer client buyer seller owner tenant patient guest attn attention dear hello hi regards sincerely signed "
    "spoke speak with met meet ask asked tell told thanks thank mother father wife husband son daughter sister brother mum mom dad colleague manager agent mailed by for von an name kunde empfänger absender herrn and und cc w per is was via",
    MAIL: "mail email e-mail mailed emailed e-mailed inbox write wrote forward forwarded reply replied schreib send sent",
    OTHER: "ref reference transaction trace bill biller invoice order terminal amount total fee fees ext extension branch code account acct serial batch receipt ticket case tracking approval baht thb eur usd price sum betrag "
    "rechnung balance iban swift sku item line",
    COMMON: "no no. nr number numbers a am an are as at be been before after again all also any back because both but can cannot could day days did do does done each even every few first get gave give go good got had has have he her here him his how i if in "
    "it its just keep know last later less like look looks made make many me more most much my near new next not now of off on once one only open or other our out over own paid pay please read ready right said same saw say says see seen she should "
    "since so some still such take than that the their them then there these they this those through time today tomorrow too two under until up us use used very wait want wants we were what when where which while who whose why will without "
    "wrong yes yesterday yet you your payment paying transfer transfers transferred successful success completed complete slip slips photo picture duplicate copy copies identical different differs scan page file morning afternoon evening night "
    "monday tuesday wednesday thursday friday saturday sunday january february march june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec am pm utc gmt und oder der die das den dem ein eine ist "
    "nicht mit bitte bei im am auf zu wurde für uhr memo note notes remark remarks details date unit box room floor flat apartment suite bank banks cash cheque deposit cards ok okay qr pls plz checked check confirm confirmed confirms received refund "
    "status need needs needed help tried try call came come go went sold buy bought order orders ordered return returned bring brought sign signed left leave lost found send change changed add added wait waits work works start started end ended visit visits appointment letter results result parcel driver customs weight meter keys key tenant tenants contract deposit voucher kettle sofa chair table chair car bus train office manual version rule hours opening holiday people person man woman lady child family friend neighbour both neither see sees good bad great nice happy angry sorry thx lol hi hello hey sir home school week month year years time times number money price cost free sale red blue green black white small large big long short high low same big first second third last next other another such only own few status approved rejected urgent unknown thb kg pcs",
    TITLE: "mr mrs ms miss mx dr prof sir madam khun herr frau fr hr mme m señor señora sr sra",
    ORG: "co ltd limited company inc llc plc corp corporation gmbh ag kg pte pcl bhd sons partners group holdings holding trading branch shop store school hospital hotel clinic restaurant foundation university association club team department",
}
THAI = {
    PHONE: "โทร โทรศัพท์ เบอร์ เบอร์โทร มือถือ พร้อมเพย์ ไลน์ โทรหา โทรกลับ",
    ID: "บัตร บัตรประชาชน เลขบัตร ประชาชน ปชช เลขประจำตัว หนังสือเดินทาง พาสปอร์ต ประจำตัว บุคคล",
    ADDRESS: "ที่อยู่ บ้านเลขที่ เลขที่ ส่งของ จัดส่ง ส่งถึง ส่งที่ ย้ายไป อาศัย พักที่ บ้าน ส่งไปที่ ที่",
    PARTY: "จาก ไปยัง ถึง ผู้รับ ผู้รับเงิน ผู้โอน ผู้ส่ง ผู้จ่าย ชื่อ ชื่อบัญชี ชื่อผู้รับ บัญชี เจ้าของ ลูกค้า ติดต่อ โดย แทน เรียน ฝาก แม่ พ่อ พี่ น้อง ภรรยา สามี เพื่อน กับ ให้ และ ของ คนชื่อ ผู้เช่า ผู้ซื้อ ผู้ขาย แจ้งว่า เป็น",
    MAIL: "อีเมล อีเมล์ เมล เมล์",
    OTHER: "อ้างอิง เลขที่อ้างอิง เลขที่บิล รายการ เลขที่รายการ รหัส จำนวน จำนวนเงิน ยอด ยอดโอน ยอดเงิน บาท ค่าธรรมเนียม บิล ใบแจ้งหนี้ ห้อง ชั้น สาขา ออเดอร์ ใบเสร็จ",
    COMMON: "แล้ว ไม่ ใน มี ได้ และ หรือ แต่ ว่า เมื่อ วันนี้ พรุ่งนี้ เมื่อวาน เวลา วันที่ โอน โอนเงิน สำเร็จ เรียบร้อย สลิป ภาพ ภาพถ่าย ซ้ำ ตรง ตรวจ ขอ รอ ใหม่ เดิม ครับ ค่ะ คะ นะ หมายเหตุ บันทึก บันทึกช่วยจำ ธนาคาร เงิน เก่า ชัด มืด ยืนยัน งวด หมู่ "
    "ถนน ซอย แขวง เขต ตำบล อำเภอ จังหวัด มกราคม กุมภาพันธ์ มีนาคม เมษายน พฤษภาคม มิถุนายน กรกฎาคม สิงหาคม กันยายน ตุลาคม พฤศจิกายน ธันวาคม น",
    TITLE: "นาย นาง นางสาว น.ส คุณ ดร ด.ช ด.ญ",
    ORG: "การค้า ขนส่ง พาณิชย์ อาหาร ก่อสร้าง การพิมพ์ สิ่งทอ อะไหล่ยนต์ เครื่องเขียน เฟอร์นิเจอร์ อุตสาหกรรม เพย์ ดิจิทัล มอเตอร์ กรุ๊ป แบงก์ วอลเล็ต ประกันภัย การเงิน การไฟฟ้า บริการ วัสดุ เครื่องครัว บริษัท บจก บมจ หจก จำกัด ห้างหุ้นส่วน มูลนิธิ สมาคม โรงเรียน โรงพยาบาล โรงแรม ร้าน สหกรณ์ ธ",
}
# Small words inside names.
PARTICLES = set("de da do dos del della der den di du la le van von bin binti ibn al el ben na ณ y e zu ter ten st".split())

_OF_LATIN = {w: k for k in (COMMON, OTHER, ADDRESS, MAIL, PHONE, ID, PARTY, ORG, TITLE) for w in LATIN[k].split()}
_OF_THAI = {w: k for k in (COMMON, OTHER, ADDRESS, MAIL, PHONE, ID, PARTY, ORG, TITLE) for w in THAI[k].split()}
_LONGEST = max(map(len, _OF_THAI))
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


@lru_cache(100_000)
def exact_class(word: str) -> int:
    """Class of a word that is listed as it stands; 0 for others."""
    w = word.casefold()
    return _OF_LATIN.get(w) or _OF_THAI.get(w) or _OF_LATIN.get(e := w.strip(".,:;'’-()")) or _OF_THAI.get(e) or 0


@lru_cache(100_000)
def word_class(word: str) -> int:
    """Class of a word; Thai is written without blanks, so there a listed word at the end counts, then one at the start."""
    out = exact_class(word)
    if out or not "฀" <= word[-1:] <= "๿":
        return out
    bare = _EDGES.sub("", word) if not word[-1:].isalnum() and word[-1:] < "฀" else word
    for n in range(min(len(bare), _LONGEST), 1, -1):
        if (k := _OF_THAI.get(bare[-n:])) and n > 2:
            return k
    for n in range(min(len(bare), _LONGEST), 2, -1):
        if k := _OF_THAI.get(bare[:n]):
            return k
    return ORG if bare.startswith(("ธ.", "บ.")) else 0
