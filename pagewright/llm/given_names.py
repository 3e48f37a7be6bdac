"""Swedish given names and their short forms (lower case)."""

# Given names, as natural text.
GIVEN = frozenset(
    """adam agnes albert alexander alf alfred algot allan amalia anders andreas anita anna anne annika anton arne arvid astrid axel
    barbro bengt bernt bertil birger birgit birgitta bo botvid britt camilla carl carina cecilia charlotta christer claes dagmar daniel
    david disa edit edvard egon einar elin elisabet elsa emil emma erik ernst eskil eva evert fanny filip folke fredrik frida
    georg gerd gertrud gottfrid greta gunilla gunnar gustav göran göte hanna hans harald harriet hedvig helena helge henrik herbert
    hilda hjalmar hugo ida inga ingegerd inger ingrid isidor ivan ivar jan jarl jeanette jens johan johanna john josef julia karin karl karl-erik
    katarina kerstin kjell klara klas klas-göran knut kristina kurt lars leif lena lennart leo leopold linnea lisa lotta ludvig magnus
    malkolm margareta maria mathilda martin mats mikael monika märta napoleon nils nils-göran olof oskar otto ottilia paulina per per-olof
    peter petronella ragnar ragnhild reinhold rikard robert roland rolf rune sebastian sigvard siv sofia solveig staffan stefan sten stig
    sture sune svante sven teodor tobias tomas torsten tyra ulf ulla ulrika urban ursula valborg viktor vivianne wilhelm yngve ylva
    åke åsa öjvind östen""".split()
)

# Short forms and the names each may stand for.
NICKNAMES = {
    k: tuple(v.split("/"))
    for k, v in (
        pair.split(":")
        for pair in """adde:anders babben:barbro berra:bertil bibbi:birgit cilla:cecilia fredde:fredrik hattan:harriet henke:henrik inga:ingegerd
        jojje:josef kalle:karl-erik/karl kicki:kerstin/kristina lasse:lars lelle:lennart leo:leopold lisbet:elisabet macke:malkolm/magnus maggan:margareta
        malla:amalia/mathilda nella:petronella nettan:jeanette nisse:nils-göran/nils ogge:oskar olle:olof palla:paulina pelle:per-olof/per
        ricke:rikard sebbe:sebastian steffo:staffan stina:kristina teo:teodor tilda:mathilda tobbe:tobias totte:torsten ulla:ulrika vicke:viktor
        vivan:vivianne wille:wilhelm kattis:katarina gurra:gustav janne:jan benke:bengt bosse:bo hasse:hans tompa:tomas micke:mikael svenne:sven""".split()
    )
}
