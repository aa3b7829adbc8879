"""Given names, titles, units and number words."""

# Given names by script and gender.
MALE = {
    "Latin": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Steven Paul Andrew George Peter Henry Hans Karl Stefan Jürgen Klaus Wolfgang Dieter Lukas Pierre Jean Michel Jacques Louis François Julien Antoine Carlos Juan José Luis Miguel Pedro Javier Diego Bob Tom Jack Ben Sam".split(),
    "Cyrillic": "Иван Алексей Дмитрий Сергей Николай Михаил Андрей Павел Владимир Юрий".split(),
}
FEMALE = {
    "Latin": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Emily Emma Olivia Anna Alice Julia Laura Sabine Monika Petra Ursula Heike Ingrid Claudia Greta Marie Sophie Camille Chloé Nathalie Isabelle Hélène Juliette María Carmen Lucía Elena Isabel Pilar Rosa Sofía Jane Kate Amy Lucy Grace".split(),
    "Cyrillic": "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Юлия Екатерина".split(),
}

# Titles before a name, by gender.
TITLES_MALE = "Mr Mister Sir Herr Monsieur Señor Sr Don Господин".split()
TITLES_FEMALE = "Mrs Ms Miss Madam Lady Frau Madame Mme Mlle Señora Sra Señorita Srta Doña Госпожа".split()
TITLES_ANY = "Dr Prof Professor Doctor".split()

# Words that say that a name comes next, and that one has just been.
NAME_NEXT = ["name is", "named", "Dear", "Hello", "Sincerely,", "Regards,", "Signed,", "signed by", "written by", "Name:", "Author:", "Contact:", "Attn:", "heiße", "heißt", "Liebe", "Lieber", "Grüße,", "appelle", "Cher", "Chère", "llamo", "llama", "Querido", "Querida", "Estimado", "Estimada"]
NAME_BEFORE = "said says called calls wrote writes told tells asked asks replied answered met meets lives lived works worked joined resigned smiled laughed left arrived sagte sagt schrieb fragte antwortete wohnt arbeitet disait écrit demanda répondit habite travaille dijo dice escribió preguntó respondió vive trabaja".split()

# Capitalised words that begin sentences or names of things, not of persons.
NO_NAME = "The A An This That These Those It He She We They You I In On At As And But Or If When While After Before For From With Mr Mrs Der Die Das Ein Eine Und Aber Le La Les Un Une Et Mais El Los Las Una Y Pero New North South East West United National Saint San White State University Company Ministry Department President Minister Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December Customer Customers Sir Sirs Madam All Team Friend Friends Reader Readers Colleague Colleagues Editor Mom Dad God Santa Kunde Kunden Kollegen Freunde Leser Grüße Gott Monsieur Madame Mademoiselle Ami Amis Client Clients Señor Señora Cliente Clientes Amigo Amigos Equipo".split()

# Syllables of made-up family names, by script.
SYLLABLES = {
    "Latin": "bar ben bor cal car col dan del dor fal fen gar gil hal har hol jar kel kor lan lor mal mar mel mor nal nor par pel ral ran rel ros sal sel sor tal tar tor val ver vin wal wen wil".split(),
    "Cyrillic": "бар бел бор вал вер вол гал гор дан дор зар кал кор лан лар мар мел мор нар нор пал пер рав рос сав сел тар тор фед хар".split(),
}

# Units of measure and currency.
UNITS = "mm cm dm m km in ft yd mi mile miles meter meters metre metres inch inches foot feet yard yards mg g kg t lb lbs oz gram grams kilogram kilograms ton tons pound pounds ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees watt watts volt volts joule joules newton newtons hz khz mhz ghz kb mb gb tb mph kph kmh".split()
#: Of these, the ones that are common words or letters, too: units after a number only.
UNITS_SHORT = "in m t s h g l ft mi min sec second degree".split()
SIGNS = ["%", "$", "€", "£", "¥", "°"]

# Number words.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()

# The same in German, French and Spanish, but articles (ein, un, una), which are no numbers for the most part.
UNITS_MORE = "meile meilen zoll fuß kilometer zentimeter millimeter gramm kilogramm tonne tonnen pfund unze unzen sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren prozent grad mètre mètres kilomètre kilomètres centimètre centimètres millimètre millimètres mille milles pouce pouces pied pieds gramme grammes kilogramme kilogrammes kilo kilos tonnes livre livres once onces litre litres seconde secondes heure heures jour jours semaine semaines mois an ans année années centime centimes degré degrés metro metros kilómetro kilómetros centímetro centímetros milímetro milímetros milla millas pulgada pulgadas pie pies gramo gramos kilogramo kilogramos tonelada toneladas libra libras onza onzas litro litros segundo segundos minuto minutos hora horas día días semana semanas mes meses año años dólar dólares céntimo céntimos grado grados".split()
NUMBERS_MORE = "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend millionen milliarde milliarden dutzend zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent cents mille millions milliard milliards douzaine cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento doscientos trescientos mil millón millones docena".split()
