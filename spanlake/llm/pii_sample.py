"""Labelled sentences for the personal-data model.

Hand-written for this library: what stands in double brackets is personal data of the kind
before the colon, everything else that a generator proposes is not.  They are the bounded
sample that the trees and thresholds are fitted on; names, numbers and addresses are invented.
"""

SENTENCES = """
Please call 555-123-4567 today|phone 555-123-4567
call 555-987-6543|phone 555-987-6543
You can reach me on 415 555 2671 after six.|phone 415 555 2671
Her number is (212) 555-0147, ask for Ann.|phone (212) 555-0147
ring 650.555.0199 before noon|phone 650.555.0199
the office, 303-555-0112, is closed|phone 303-555-0112
Fax 617-555-0175 or write|phone 617-555-0175
old friends met there 702-555-0133 and talked|phone 702-555-0133
un numéro 514-555-0190 pour vous|phone 514-555-0190
el número es 786-555-0104 ahora|phone 786-555-0104
Tel.: 030 1234567 ab neun|phone 030 1234567
Tel. 0221 9876543|phone 0221 9876543
Telefon: 089 123456 bis|phone 089 123456
Tél : 01 23 45 67 89 le matin|phone 01 23 45 67 89
phone 020 7946 0958 please|phone 020 7946 0958
call (0131) 496 0123 at work|phone (0131) 496 0123
Ruf 0711 555123 heute|phone 0711 555123
mob 07700 900123 any time|phone 07700 900123
+1 (212) 555-0147 for the desk|phone +1 (212) 555-0147
under +49 30 1234567 und dann|phone +49 30 1234567
al +34 912 345 678 por favor|phone +34 912 345 678
+44 20 7946 0958|phone +44 20 7946 0958
words around +33 1 23 45 67 89 words|phone +33 1 23 45 67 89
part id a555-123-4567b of the list|
see x212-555-0147y in the code|
key k9415 555 2671z again|
hash f303-555-0112e here|
the formula +1 is small|
we scored +3 2 1 in a row|
a gain of +12.5 in May|
range +1234 to +99|
call 01.02.2024 for the fair|
phone 03/04/2023 was the date|
Tel 05-06-2021 notes|
fax 01 23 no|
order _555-123-4567_ pending|
sku A12 345 678 9012C|
number +1234567890123456789012 in the log|
pay 378282246310005 or less|card 378282246310005
card 371449635398431 on file|card 371449635398431
my diners 30569309025904 card|card 30569309025904
visa 4222222222222 old|card 4222222222222
Amex: 3782 822463 10005|card 3782 822463 10005
charged to 4111111111111111 now|card 4111111111111111
card no 5500 0000 0000 0004 thanks|card 5500 0000 0000 0004
words 4012888888881881 words|card 4012888888881881
4242-4242-4242-4242 for the deposit|card 4242-4242-4242-4242
use 6011111111111117 then|card 6011111111111117
la carte 5105105105105100 est|card 5105105105105100
mit 4000056655665556 bezahlt|card 4000056655665556
at 1700000000000 ms the job ended|
epoch 1699999999999 was logged|
no 4111111111111112 was wrong|
row 1234567890123456 of the table|
serial 9876543210987654 on the back|
isbn 9780306406157 in print|
ean 4006381333931 on the box|
id 12345678901234 in the ledger|
tracking 9400110200881234 went out|
total 00000000000000 pieces|
block a4111111111111111b of hex|
1.2.3.4 answered|ip 1.2.3.4
host 192.168.0.17 is down|ip 192.168.0.17
from 10.0.0.1 to the gate|ip 10.0.0.1
login at 203.0.113.9 failed|ip 203.0.113.9
address 198.51.100.23 was banned|ip 198.51.100.23
words 81.237.141.155 words|ip 81.237.141.155
version 300.1.2.3 is out|
chapter 1.2.3.999 explains|
build 2023.10.12.1 shipped|
oid 1.3.6.1999 entry|
section 256.1.1.1 of the act|
write to jane.roe@example.com soon|email jane.roe@example.com
a@b.org now|email a@b.org
mail x.y+z@h-1.example.net or|email x.y+z@h-1.example.net
words max_9@mail3.example.com words|email max_9@mail3.example.com
ask jo.doe (at) mail.example.com or|email jo.doe (at) mail.example.com
ask jo [at] example [dot] com or|email jo [at] example [dot] com
contact info(at)firma.de for help|email info(at)firma.de
mail an erika [at] beispiel.de heute|email erika [at] beispiel.de
sue [at] uni [dot] edu knows|email sue [at] uni [dot] edu
escribe a luis (at) correo (dot) es|email luis (at) correo (dot) es
we met (at) noon.then we left|
look [at] 3.4 again|
buy (at) 10.99 each|
start (at) 5.30 sharp|
point [at] 2.5 only|
"""
